"""Stupid-backoff scores over count tables partitioned by hash.

Documents are gathered into *chunks* of about ``chunk_words`` words.  Each chunk sends its distinct n-grams (words and word
pairs) with their number to the parts of the count table, one part for each range of 64-bit hashes; a part adds up what all
chunks sent and answers each of them; a chunk joins the answers to the n-grams of its documents and sums them per document.
So an n-gram crosses the network once for each chunk that has it, not once for each document, and a pair that every
document holds weighs no more than one that a document of every chunk holds.

A document's own pairs do not speak for it: its own counts are taken off before a pair is looked up (leave-one-out), so a
text that only repeats itself scores low.  For a word ``w`` after ``v`` (or after the start of the text), with counts
outside the document for the pair and for ``v``::

    S(w | v) = c(v w) / c(v)            if the pair occurs in another document
               backoff * c(w) / N       otherwise, over all documents
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import each_text, keep, mix, map_batches, safe_columns, word_hashes

BACKOFF = 0.4
CHUNK_WORDS = 1_000_000
PART_GRAMS = 2_000_000
START = np.uint64(0x53544152545F5F5F)
_U = np.uint64


def squeeze(x: np.ndarray) -> bytes:
    """64-bit numbers as compressed bytes, all first bytes before all second ones: small numbers and near neighbours take little room on the way."""
    return pa.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


class Grams:
    """The distinct n-grams of a chunk; the start of a text is a word that comes last in the vocabulary."""

    def __init__(self, n_words: np.ndarray, vocabulary: np.ndarray, codes: np.ndarray):
        self.n_words, self.w = n_words, codes.astype(np.int64)
        self.size = len(vocabulary) + 1
        self.doc = np.repeat(np.arange(len(n_words)), n_words)
        self.v = np.concatenate([[0], self.w[:-1]])
        self.v[np.cumsum(n_words) - n_words] = self.size - 1
        pairs, self.pair = np.unique(self.v * self.size + self.w, return_inverse=True)
        self.pair_v, self.pair_w = pairs // self.size, pairs % self.size
        words = np.concatenate([vocabulary, [START]])
        hashes = np.concatenate([mix(words ^ _U(1)), mix(mix(words)[self.pair_v] * _U(3) + words[self.pair_w])])
        number = np.concatenate([np.bincount(self.w, minlength=self.size), np.bincount(self.pair)])
        number[self.size - 1] = len(n_words)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.number = hashes[self.order], number[self.order]

    def log_scores(self, counts: np.ndarray, total: int, backoff: float) -> np.ndarray:
        """Sum of log S of each document, from the corpus counts of ``hashes``."""
        c = np.empty(len(counts), np.int64)
        c[self.order] = counts
        of_word, of_pair = c[:self.size], c[self.size:]
        n_docs, n_pairs = len(self.n_words), len(of_pair)
        held, n = np.unique(self.doc * n_pairs + self.pair, return_counts=True)
        doc, pair = held // n_pairs, held % n_pairs
        v, w = self.pair_v[pair], self.pair_w[pair]
        uses, times = np.unique(np.concatenate([self.doc * self.size + self.w, np.arange(n_docs) * self.size + self.size - 1]), return_counts=True)
        outside = of_pair[pair] - n
        seen = outside > 0
        of_v = of_word[v] - times[np.searchsorted(uses, doc * self.size + v)]
        share = np.where(seen, outside / np.where(seen, of_v, 1), backoff * of_word[w] / total)
        return np.bincount(doc, weights=n * np.log(share), minlength=n_docs)


def chunks(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``chunk, doc_ids, n_words, vocabulary, codes, n_grams``: documents with words, about ``chunk_words`` words together (a longer one alone closes its chunk).

    ``codes`` are the words as places in the vocabulary, the commonest word first, squeezed. Chunk numbers hold for one run only: store the table before use.
    """
    def pack(ids: list[int], words: list[np.ndarray], number: int) -> pa.RecordBatch:
        vocabulary, codes, times = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
        common = np.argsort(-times, kind="stable")
        place = np.empty(len(common), np.int32)
        place[common] = np.arange(len(common), dtype=np.int32)
        codes, n_words = place[codes], np.array([len(w) for w in words])
        n_grams = len(Grams(n_words, vocabulary[common], codes).hashes)
        row = {"chunk": number, "doc_ids": ids, "n_words": n_words.tolist(), "vocabulary": vocabulary[common].view(np.int64).tolist(),
               "codes": squeeze(codes), "n_grams": n_grams}
        return pa.RecordBatch.from_pylist([row], pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())),
                                                            ("vocabulary", pa.list_(pa.int64())), ("codes", pa.binary()), ("n_grams", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, size, number = [], [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), each_text(b.column(1))):
                found = word_hashes(text.lower())
                if doc is None or not len(found):
                    continue
                ids.append(doc), words.append(found)
                size += len(found)
                if size >= chunk_words:
                    yield pack(ids, words, number)
                    ids, words, size, number = [], [], 0, number + 1
        if ids:
            yield pack(ids, words, number)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "chunk bigint, doc_ids array<bigint>, n_words array<int>, vocabulary array<bigint>, codes binary, n_grams bigint")


def _each(t, column: str, kind):
    for row in t.column(column):
        yield row.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _grams(t) -> Iterator[Grams]:
    for n_words, vocabulary, codes in zip(_each(t, "n_words", np.int64), _each(t, "vocabulary", np.int64), t.column("codes")):
        yield Grams(n_words, vocabulary.view(np.uint64), unsqueeze(codes.as_py(), int(n_words.sum())))


def requests(stored: DataFrame, parts: int) -> DataFrame:
    """``part, chunk, n, grams, number``: the sorted distinct n-gram hashes of each chunk (as differences) and how often, squeezed, by the part of the count table that holds them."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for chunk, g in zip(b.column("chunk").to_pylist(), _grams(b)):
            part = ((g.hashes >> _U(32)) * _U(parts)) >> _U(32)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            for p, grams, number in zip(part[first].tolist(), np.split(g.hashes.view(np.int64), first[1:]), np.split(g.number, first[1:])):
                rows.append((p, chunk, len(grams), squeeze(np.diff(grams, prepend=0)), squeeze(number)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "chunk", "n", "grams", "number"])
    return map_batches(stored, run, "part bigint, chunk bigint, n bigint, grams binary, number binary")


def answers(asked: DataFrame) -> DataFrame:
    """``part, chunk, n, counts``: the corpus counts of the n-grams of each request, in its order, squeezed."""
    def count(t: pa.Table) -> pa.Table:
        n = t.column("n").to_pylist()
        _, at = np.unique(np.concatenate([np.cumsum(unsqueeze(x.as_py(), k)) for x, k in zip(t.column("grams"), n)]), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate([unsqueeze(x.as_py(), k) for x, k in zip(t.column("number"), n)])).astype(np.int64)[at]
        told = pa.array([squeeze(x) for x in np.split(c, np.cumsum(n)[:-1])], pa.binary())
        return pa.table({"part": t.column("part"), "chunk": t.column("chunk"), "n": t.column("n"), "counts": told})
    return asked.groupBy("part").applyInArrow(count, "part bigint, chunk bigint, n bigint, counts binary")


def score_documents(docs: DataFrame, backoff: float = BACKOFF, chunk_words: int = CHUNK_WORDS, part_grams: int = PART_GRAMS) -> DataFrame:
    """Add ``n_words``, ``log_score`` (sum of log S) and ``mean_score`` (per word) to every document.

    Words are runs of anything but white space, A-Z lower-cased. Null and empty texts, texts of white space and rows with a null ``doc_id`` have 0 words and null
    scores. Ids are distinct (rows that share one are scored one by one and added up). Extra columns are carried along; raises if a result column is already there.
    ``chunk_words`` and ``part_grams`` (n-grams that come together in one part) bound a task's memory and do not change results.
    """
    safe_columns(docs, ["n_words", "log_score", "mean_score"])
    stored = keep(chunks(docs, chunk_words))
    size = stored.agg(F.sum("n_grams").alias("grams"), F.sum(F.aggregate("n_words", F.lit(0).cast("bigint"), lambda a, n: a + n)).alias("words")).first()  # one row
    total = int(size["words"] or 0)

    def score(asker: pa.Table, answered: pa.Table) -> pa.Table:
        answered = answered.sort_by("part")
        counts = np.concatenate([unsqueeze(x.as_py(), n) for x, n in zip(answered.column("counts"), answered.column("n").to_pylist())])
        found = [(ids, n, g.log_scores(counts, total, backoff)) for ids, n, g in zip(_each(asker, "doc_ids", np.int64), _each(asker, "n_words", np.int64), _grams(asker))]
        return pa.table({"_id": np.concatenate([f[0] for f in found]), "n_words": np.concatenate([f[1] for f in found]), "log_score": np.concatenate([f[2] for f in found])})

    told = answers(requests(stored, max(1, -(-int(size["grams"] or 0) // part_grams))))
    scored = stored.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, "_id bigint, n_words bigint, log_score double")
    scores = scored.groupBy("_id").agg(F.sum("n_words").alias("n_words"), F.sum("log_score").alias("log_score"))
    out = docs.join(scores, F.col("doc_id").cast("bigint") == F.col("_id"), "left").drop("_id")
    return out.select(*docs.columns, F.coalesce("n_words", F.lit(0)).cast("bigint").alias("n_words"), "log_score", (F.col("log_score") / F.col("n_words")).alias("mean_score"))
