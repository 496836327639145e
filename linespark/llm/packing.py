"""Packing by shortest-pack-first over the histogram of piece lengths.

A document's token ids are cut into pieces of at most ``size``.  Only the histogram of piece lengths (at most ``size``
entries, whatever the corpus) goes to the driver.  There lengths are placed longest first, each into the packs that have
the most room left, and packs of equal content are one *pattern* with a count.  Every pattern takes a run of ranks of
each of its lengths; pieces are ranked inside their length and joined to the pattern that holds their rank.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import each_text, keep, worker_cache

SIZE = 2048
END_ID = 1
CACHE = 700_000


def plan_packs(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(count, [(length, how many), ...])`` for each pattern: packs of equal content, lengths falling.

    Longest first; a length goes to the packs with the most room, and opens new packs when it fits none. The number of
    patterns is bounded by ``size``, not by the counts.
    """
    room: dict[int, list[list]] = {}      # room left -> open patterns [count, content]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            best = max((r for r in room if r >= length), default=0)
            if not best:
                fit = max(1, min(left, size // length))
                packs, rest = divmod(left, fit)
                room.setdefault(size - fit * length, []).append([packs, ((length, fit),)])
                if rest:
                    room.setdefault(size - rest * length, []).append([1, ((length, rest),)])
                break
            packs, content = room[best].pop()
            if not room[best]:
                del room[best]
            # If even so many packs cannot take one each, the rest of the pattern stays open as it is.
            take = min(packs, left)
            if take < packs:
                room.setdefault(best, []).append([packs - take, content])
            left -= take
            last, n = content[-1]
            grown = (*content[:-1], (last, n + 1)) if last == length else (*content, (length, 1))
            room.setdefault(best - length, []).append([take, grown])
    return [(packs, list(content)) for r in room.values() for packs, content in r]


def intervals(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first_rank, end_rank, first_sequence, per_pack, offset)``: which ranks of a length go where.

    Rank ``r`` of an interval lies in sequence ``first_sequence + (r - first_rank) div per_pack``.
    """
    used: dict[int, int] = {}
    out, sequence = [], 0
    for packs, content in patterns:
        offset = 0
        for length, n in content:
            first = used.get(length, 0)
            used[length] = first + packs * n
            out.append((length, first, first + packs * n, sequence, n, offset))
            offset += length * n
        sequence += packs
    return out


#: Latin letters up to U+017F whose lower case is one letter and which composition leaves alone.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_STOPS = (b".", b",")


class _WordIds(dict):
    """Token ids, as bytes, of white-space separated chunks; each distinct chunk is encoded once while it is remembered.

    For lower-casing byte-level tokenizers that always split at white space and between letters and punctuation. A chunk
    of Latin letters is one pre-token and goes straight to the model; any other chunk takes the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        from tokenizers.pre_tokenizers import ByteLevel
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.marks = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x180)}

    def __missing__(self, chunk: bytes) -> bytes:
        word = chunk.decode()
        if _LATIN.fullmatch(word):
            data = array("I", [t.id for t in self.model.tokenize(word.lower().translate(self.letters))]).tobytes()
        elif chunk[-1:] in _STOPS and _LATIN.fullmatch(word, 0, len(word) - 1):
            data = self[chunk[:-1].lower()] + self[chunk[-1:]]
        else:
            data = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[chunk] = data
        return data

    def encode(self, text: bytes) -> bytes:
        if len(self) > CACHE:
            self.clear()
        return b"".join([self[w] for w in self.folded(text).split()])

    def folded(self, text: bytes) -> bytes:
        """The text with A-Z lower-cased, so that forms of a word share an entry, where that gives the same ids.

        It may not when the text holds an added token in some case, or U+0300 to U+033F (lead byte CC): composition comes before
        lower-casing, and h, j, t, w and y have composed forms that their capitals lack.
        """
        low = text.lower()
        return text if b"\xcc" in text or any(m in low for m in self.marks) else low


def _word_ids(path: str) -> _WordIds:
    """One for each Python worker, kept from task to task."""
    held = worker_cache(__name__)
    if path not in held:
        held[path] = _WordIds(path)
    return held[path]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, part, place`` and ``ids``: a document's ids and the end id, cut at ``size``.

    ``place`` counts the pieces of one length inside a task (``part``). Null text is empty and gives the end id alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = _word_ids(tokenizer_path), TaskContext.get().partitionId(), {}
        end = array("I", [end_id]).tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), each_text(b.column(1))):
                data = words.encode(text) + end
                tokens = len(data) // 4
                for start in range(0, tokens, size):
                    piece = data[start * 4:(start + size) * 4]
                    length = len(piece) // 4
                    place = seen.get(length, 0)
                    seen[length] = place + 1
                    rows.append((doc, start, length, zlib.crc32(piece), tokens, part, place, piece))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place", "ids"])
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, place bigint, ids binary"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (``length, part, place``); every piece gets exactly one place.

    ``pieces`` must be a stored table, as its ranks are counted first and used later. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    cells = pieces.groupBy("part", "length").agg(F.count("*").alias("_n"))
    # One row per task and length, so even a length that all documents share has no more rows than there were tasks.
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = keep(cells.select("part", "length", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `size` rows
    runs = spark.createDataFrame(intervals(plan_packs(histogram, size)) or [(0, 0, 0, 0, 1, 0)],
                                 "length bigint, _first bigint, _end bigint, _sequence bigint, _per bigint, _offset bigint")
    ranked = pieces.join(bases.drop("_n"), ["part", "length"]).withColumn("_rank", F.col("_base") + F.col("place"))
    placed = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))).drop(runs["length"])
    nth = F.col("_rank") - F.col("_first")
    return placed.withColumns({"sequence_id": F.col("_sequence") + F.expr("(_rank - _first) div _per"), "offset": F.col("_offset") + nth % F.col("_per") * F.col("length")}).drop("_base", "_rank", "_first", "_end", "_sequence", "_per", "_offset", "part", "place")


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Tokenize documents and pack them: one row per piece with its sequence, offset, checksum and (``with_ids``) token ids.

    Only ``doc_id`` and ``text`` are read, whatever other columns there are; null text is empty, a repeated ``doc_id`` is packed as often as it comes.
    """
    pieces = tokenize_pieces(docs, tokenizer_path, size, end_id)
    return pack(keep(pieces if with_ids else pieces.drop("ids")), size)
