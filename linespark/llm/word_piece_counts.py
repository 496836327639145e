"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that begin a word (marked ``\\u2581``) and pieces that continue one.  Where no
further byte fits, the automaton follows the failure link of its node: the node that is reached after the greedy pieces
of what was read are taken off, with their number stored beside it.  So a word costs one step for each byte and each piece,
nothing is read twice and no piece is built.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import each_text, map_batches, safe_columns

MARK = "▁".encode()
REMEMBERED = 500_000
LONGEST_REMEMBERED = 64


class Automaton(dict):
    """Counts of greedy pieces by word; a word that pieces cannot spell is one unknown piece, counted as -1."""

    def __init__(self, pieces: list[bytes]):
        super().__init__()
        self.go: list[dict[int, int]] = [{}, {}]       # node 0 begins words, node 1 continues them
        is_piece = {}
        for piece in pieces:
            at = 0 if piece.startswith(MARK) else 1
            for byte in piece:
                nxt = self.go[at].get(byte)
                if nxt is None:
                    nxt = self.go[at][byte] = len(self.go)
                    self.go.append({})
                at = nxt
            is_piece[at] = True
        self.fail, self.popped = [-1] * len(self.go), [0] * len(self.go)
        todo = deque((parent, byte, child) for parent in (0, 1) for byte, child in self.go[parent].items())
        while todo:
            parent, byte, node = todo.popleft()
            if node in is_piece:
                self.fail[node], self.popped[node] = 1, 1
            else:
                taken, z = self.popped[parent], self.fail[parent]
                while z >= 0 and byte not in self.go[z]:
                    taken, z = taken + self.popped[z], self.fail[z]
                if z >= 0:
                    self.fail[node], self.popped[node] = self.go[z][byte], taken
            todo.extend((node, b, c) for b, c in self.go[node].items())

    def count(self, word: bytes) -> int:
        go, fail, popped = self.go, self.fail, self.popped
        at = n = 0
        for byte in MARK + word:
            while (nxt := go[at].get(byte)) is None:
                if fail[at] < 0:
                    return -1
                n += popped[at]
                at = fail[at]
            at = nxt
        while at != 1:
            if fail[at] < 0:
                return -1
            n += popped[at]
            at = fail[at]
        return n

    def __missing__(self, word: bytes) -> int:
        n = self.count(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def pieces_of(model_path: str) -> list[bytes]:
    """The ordinary pieces of a sentencepiece model file."""
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=model_path)
    return [sp.id_to_piece(i).encode() for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]


_worker: dict[str, Automaton] = {}


def _automaton(path: str) -> Automaton:
    if path not in _worker:
        _worker[path] = Automaton(pieces_of(path))
    return _worker[path]


def count_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """``n_words``, ``n_pieces`` and ``n_unknown`` (words that are one unknown piece each) beside every column but ``text``.

    Words are runs of anything but white space. Null and empty texts have none; repeated rows get the same counts. Raises if a result column is already there.
    """
    safe_columns(docs, ["n_words", "n_pieces", "n_unknown"])
    others = [c for c in docs.columns if c != "text"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        automaton, words, pieces, unknown = _automaton(model_path), [], [], []
        for text in each_text(b.column("text")):
            counts = [automaton[w] for w in text.split()]
            bad = counts.count(-1)
            words.append(len(counts))
            unknown.append(bad)
            pieces.append(sum(counts) + 2 * bad)
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in others), *(pa.array(x, pa.int64()) for x in (words, pieces, unknown))], [*others, "n_words", "n_pieces", "n_unknown"])
    from pyspark.sql.types import LongType, StructField, StructType
    schema = StructType([*(docs.schema[c] for c in others), *(StructField(c, LongType()) for c in ("n_words", "n_pieces", "n_unknown"))])
    return map_batches(docs.select(*others, F.col("text")), run, schema)
