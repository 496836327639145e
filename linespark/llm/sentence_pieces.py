"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The best segmentation has the largest sum of piece scores.  A character that no piece covers alone costs ten less than
the lowest score and becomes its UTF-8 bytes as byte pieces.  White space is kept as the marker ``\\u2581``, with one more in front of
a text that is not empty; decoding turns markers back and takes that one off, so every text comes back as it was (a marker
character in the text itself travels as bytes).

No piece has a marker after another character, nor a line break, so a text falls into chunks (blanks and what follows them) that are
segmented one by one, and each distinct chunk once while it is remembered.
"""

from __future__ import annotations

import re
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import each_text, map_batches, safe_columns

UNKNOWN_COST = 10.0
REMEMBERED = 600_000
LONGEST_REMEMBERED = 96
_CHUNK = re.compile(rb" +[^ \n]*|[^ \n]+|\n+")
_FINER_CHUNK = re.compile(rb" *[^ .,\n]*[A-Za-z](?=[.,])|" + _CHUNK.pattern)
NONE = float("-inf")


class DoubleArray:
    """A trie in two arrays: child ``c`` of node ``s`` is ``base[s] + c + 1`` where ``check`` names ``s``."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in keys.items():
            at = 0
            for byte in key:
                nxt = children[at].get(byte)
                if nxt is None:
                    nxt = children[at][byte] = len(children)
                    children.append({})
                    value.append(-1)
                at = nxt
            value[at] = v
        size = 2 * len(children) + 512
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        free, todo = 1, [(0, 0)]
        while todo:
            node, slot = todo.pop()
            self.value[slot] = value[node]
            codes = sorted(children[node])
            if not codes:
                continue
            while self.check[free] >= 0:
                free += 1
            base, tried = max(0, free - codes[0] - 1), 0
            while True:
                if base + 258 > len(self.check):
                    grow = len(self.check)
                    self.base += [0] * grow
                    self.check += [-1] * grow
                    self.value += [-1] * grow
                if all(self.check[base + c + 1] < 0 for c in codes):
                    break
                base += 1
                tried += 1
                if tried > 64:  # crowded here: leave the holes to smaller nodes
                    free += 1
                    tried = 0
                    while self.check[free] >= 0:
                        free += 1
                    base = max(base, free - codes[0] - 1)
            self.base[slot] = base
            for c in codes:
                self.check[base + c + 1] = slot
                todo.append((children[node][c], base + c + 1))


class Pieces(dict):
    """Encoder and decoder of one model; remembers the ids, as bytes, of chunks."""

    def __init__(self, pieces: list[bytes], scores: list[float], byte_ids: dict[int, int], controls: set[int] = frozenset()):
        super().__init__()
        ordinary = {p.replace(b"\xe2\x96\x81", b" "): i for i, p in enumerate(pieces) if i not in controls and i not in byte_ids.values()}
        if any(b"\n" in p or b" " in p.lstrip(b" ") for p in ordinary):
            raise ValueError("pieces that hold a line break or a marker inside are not supported")
        self.trie, self.scores, self.byte_ids = DoubleArray(ordinary), scores, byte_ids
        self.score_at = [scores[v] if v >= 0 else NONE for v in self.trie.value]
        self.alone = {p for p in ordinary if len(p.decode()) == 1}
        self.longest = max(map(len, ordinary), default=1)
        # Where no piece has a full stop or comma after a letter, a chunk falls apart there too.
        self.chunk = _CHUNK if any(re.search(rb"[A-Za-z][.,]", p) for p in ordinary) else _FINER_CHUNK
        self.unknown = min((scores[i] for i in ordinary.values()), default=0.0) - UNKNOWN_COST
        self.out = {i: p for p, i in ordinary.items()} | {i: bytes([b]) for b, i in byte_ids.items()}

    @classmethod
    def load(cls, model_path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        return cls([x.encode() for x in names], [sp.get_score(i) for i in range(n)], {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)},
                   {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)})

    def segment(self, chunk: bytes) -> list[int]:
        """Ids of the best segmentation; among equal sums the one that the shorter last pieces reach first."""
        base, check, score, n = self.trie.base, self.trie.check, self.score_at, len(chunk)
        best, piece, back = [0.0] + [NONE] * n, [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            so_far = best[i]
            if so_far == NONE:
                continue
            slot, j = 0, i
            for c in chunk[i:i + self.longest]:
                nxt = base[slot] + c + 1
                if check[nxt] != slot:
                    break
                slot = nxt
                j += 1
                total = so_far + score[slot]
                if total > best[j]:
                    best[j], piece[j], back[j] = total, slot, i
            lead = chunk[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            if chunk[i:i + width] not in self.alone:
                j, total = i + width, so_far + self.unknown
                if total > best[j]:
                    best[j], piece[j], back[j] = total, -1, i
        out, j = [], n
        while j:
            i = back[j]
            if piece[j] >= 0:
                out.append(self.trie.value[piece[j]])
            else:
                out.extend(self.byte_ids[b] for b in reversed(chunk[i:j]))
            j = i
        out.reverse()
        return out

    def __missing__(self, chunk: bytes) -> bytes:
        data = array("I", self.segment(chunk)).tobytes()
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = data
        return data

    def encode(self, text: bytes) -> bytes:
        """Ids as unsigned little-endian 32-bit values."""
        return b"".join([self[c] for c in self.chunk.findall(b" " + text)]) if text else b""

    def decode(self, ids: bytes) -> bytes:
        out = self.out
        text = b"".join([out.get(i, b"") for i in memoryview(ids).cast("I")])
        return text[1:] if text[:1] == b" " else text


_worker: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _worker:
        _worker[path] = Pieces.load(path)
    return _worker[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Replace ``text`` by ``piece_ids`` (binary, little-endian unsigned 32-bit), ``n_pieces`` and ``ids_crc32``.

    Null and empty texts have no ids. Other columns are carried along; raises if a result column is already there.
    """
    safe_columns(docs, ["piece_ids", "n_pieces", "ids_crc32"])
    others = [c for c in docs.columns if c != "text"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pieces = _pieces(model_path)
        ids = [pieces.encode(t) for t in each_text(b.column("text"))]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                                           pa.array([zlib.crc32(x) for x in ids], pa.int64())], [*others, "piece_ids", "n_pieces", "ids_crc32"])
    schema = StructType([*(docs.schema[c] for c in others), StructField("piece_ids", BinaryType()), StructField("n_pieces", LongType()), StructField("ids_crc32", LongType())])
    return map_batches(docs.select(*others, "text"), run, schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Replace ``piece_ids`` by ``text``. Ids outside the vocabulary and control pieces are left out; null ids give an empty text.

    Bytes that are not UTF-8 (possible only for ids that no text encodes to) become U+FFFD.
    """
    safe_columns(encoded, ["text"])
    others = [c for c in encoded.columns if c != "piece_ids"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pieces = _pieces(model_path)
        texts = [pieces.decode(x).decode("utf-8", "replace") for x in each_text(b.column("piece_ids"))]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(texts, pa.string())], [*others, "text"])
    return map_batches(encoded.select(*others, "piece_ids"), run, StructType([*(encoded.schema[c] for c in others), StructField("text", StringType())]))
