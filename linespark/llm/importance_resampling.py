"""Importance resampling towards a target distribution, with exact weights from bit-sliced counts.

A document is its counts of hashed word runs in ``BUCKETS`` buckets.  A bucket's *gain* is the scaled and floored log ratio of its share
in the target texts and in the documents, so gains are integers and a document's weight, the floored mean of the gains of its features, is
exact.  Counts become bit planes: plane ``p`` of a document has one bit for each bucket, set where bit ``p`` of the count is.  Gains become
planes of their magnitudes, one set for positive and one for negative gains.  The sum of count times gain is then a sum over pairs of planes
of ``2**(p + q)`` times the bits that both have (AND, population count).

Both bucket histograms are bounded by ``BUCKETS`` rows however large the corpus is; only the gains go to the driver and the tasks.

Gumbel noise from a hash of the id is added to the weight, and the highest scores are drawn: that is sampling without replacement by
weight, and it gives the same draw each time.  The drawing limit is read off the histogram of the integer scores, so only rows that reach it
are put in order, by range partitioning.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.ordered import global_rank
from .common import each_text, keep

BUCKETS = 10_000
RUN = 1
SCALE = 1000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Distinct features whose buckets a worker remembers.
CACHE = 500_000
#: Documents whose planes are in memory together, and bytes of a text that are cut into words together.
SLICE, PIECE = 256, 1 << 20
_WORD_BYTES = bytes(c if chr(c).isdigit() or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(128)) + bytes(range(128, 256))
_RESULTS = ["n_words", "n_features", "weight", "score", "rank"]


def words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a UTF-8 text, some at a time: runs of ASCII letters (lower-cased), digits and all characters beyond ASCII."""
    start = 0
    while start < len(text):
        # A cut is made where a blank stands, which is no part of a word.
        blank = re.compile(rb"[\x00-\x20]").search(text, start + PIECE) if len(text) - start > 2 * PIECE else None
        end = blank.start() if blank else len(text)
        yield text[start:end].translate(_WORD_BYTES).split()
        start = end


class _Buckets(dict):
    """Bucket of each feature (words joined by a blank), remembered."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[feature] = b = zlib.crc32(feature) % BUCKETS
        return b


_buckets = _Buckets()


def bucket_counts(text: bytes, run: int = RUN) -> tuple[np.ndarray, int]:
    """Counts of the features (all runs of 1 to ``run`` words) in each bucket, and the number of words."""
    counts, n, tail = np.zeros(BUCKETS, np.int64), 0, []
    for some in words(text):
        n += len(some)
        found = [_buckets[w] for w in some]
        for size in range(2, run + 1):  # runs that end in these words, begun in the piece before if need be
            joined = tail[max(0, len(tail) - size + 1):] + some
            found += [_buckets[b" ".join(joined[i:i + size])] for i in range(len(joined) - size + 1)]
        tail = (tail + some)[-(run - 1):] if run > 1 else []
        if found:
            counts += np.bincount(np.array(found, np.int64), minlength=BUCKETS)
    return counts, n


def histogram(texts: DataFrame, run: int = RUN) -> DataFrame:
    """``bucket, n``: features of all ``text``s in each bucket that has any; a task sends at most ``BUCKETS`` rows."""
    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text in each_text(b.column(0)):
                total += bucket_counts(text, run)[0]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])
    return texts.select("text").mapInArrow(run_task, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(target: DataFrame, corpus: DataFrame) -> DataFrame:
    """``bucket, gain`` for all buckets from two histograms, both smoothed by one feature a bucket."""
    spark = corpus.sparkSession
    side = lambda h, n: h.select(F.col("bucket").alias(f"_{n}"), F.col("n").alias(n))
    total = lambda h, n: h.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(n))
    every = spark.range(BUCKETS).select(F.col("id").alias("bucket"))
    cells = (every.join(side(target, "t"), F.col("bucket") == F.col("_t"), "left").join(side(corpus, "s"), F.col("bucket") == F.col("_s"), "left")
             .crossJoin(F.broadcast(total(target, "T1").crossJoin(total(corpus, "S1")))))  # one row of totals
    of = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = (of("t") + 1) * (of("S1") + BUCKETS) / ((of("s") + 1) * (of("T1") + BUCKETS))
    return cells.select("bucket", F.floor(SCALE * F.log(ratio)).cast("bigint").alias("gain"))


def bit_planes(counts: np.ndarray) -> np.ndarray:
    """Row ``p`` has bit ``b`` set where bit ``p`` of ``counts[b]`` is; 64 buckets a word."""
    n = int(counts.max(initial=0)).bit_length()
    padded = np.zeros(-(-len(counts) // 64) * 64, np.int64)
    padded[:len(counts)] = counts
    bits = (padded >> np.arange(n)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)


def weighted_sums(planes: list[np.ndarray], gains: np.ndarray) -> np.ndarray:
    """For each document's planes the sum of count times gain: powers of two times the bits shared with the signed gain planes."""
    above, below = bit_planes(np.maximum(gains, 0)), bit_planes(np.maximum(-gains, 0))
    sizes = np.array([len(p) for p in planes])
    stacked = np.concatenate(planes) if sizes.sum() else np.empty((0, above.shape[1] if len(above) else 0), np.uint64)
    shared = np.zeros(len(stacked), np.int64)
    for sign, side in ((1, above), (-1, below)):
        for q, plane in enumerate(side):
            shared += sign * (np.bitwise_count(stacked & plane).sum(1, dtype=np.int64) << q)
    power = np.concatenate([np.arange(n) for n in sizes]) if sizes.sum() else np.empty(0, np.int64)
    out = np.zeros(len(planes), np.int64)
    np.add.at(out, np.repeat(np.arange(len(planes)), sizes), shared << power.astype(np.int64))
    return out


def weigh(docs: DataFrame, gains: np.ndarray, run: int = RUN, carry_text: bool = False) -> DataFrame:
    """Add ``n_words``, ``n_features`` and ``weight`` to every document. Null and empty texts have none of either and weigh 0."""
    names = [c for c in docs.columns if c not in _RESULTS and (carry_text or c != "text")]

    def run_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                b = whole.slice(start, SLICE)
                counted = [bucket_counts(text, run) for text in each_text(b.column(b.num_columns - 1))]
                n_features = np.array([int(c.sum()) for c, _ in counted])
                sums = weighted_sums([bit_planes(c) for c, _ in counted], gains)
                weight = np.where(n_features > 0, sums // np.maximum(n_features, 1), 0)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([n for _, n in counted], pa.int64()), pa.array(n_features, pa.int64()), pa.array(weight, pa.int64())],
                                                 [*names, "n_words", "n_features", "weight"])
    from pyspark.sql.types import LongType, StructField, StructType
    schema = StructType([*(docs.schema[c] for c in names), *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))])
    return docs.select(*names, F.col("text").alias("_text")).mapInArrow(run_batch, schema)


def noise(seed: int = SEED, doc_id: str = "doc_id") -> Column:
    """Gumbel noise, scaled and floored, from the hash of seed and id; a null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Add ``rank`` to a stored table with ``_at`` (a number of its own for each row): 1, 2, 3 ... for the drawn, null for the others.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred (floored) with the highest scores, ties to the smaller ``doc_id``.
    """
    able = F.col("n_words") >= min_words
    wanted = scored.filter(able).count() * percent // 100
    # Scores are integers in a narrow range, so their histogram is small whatever the number of documents.
    per_score = scored.filter(able).groupBy("score").agg(F.count("*").alias("n"))
    reached = per_score.withColumn("_from_top", F.sum("n").over(W.orderBy(F.desc("score"))))
    limit = reached.filter(F.col("_from_top") >= wanted).agg(F.max("score")).first()[0] if wanted else None
    none = F.lit(None).cast("bigint")
    if limit is None:
        return scored.withColumn("rank", none).drop("_at")
    high = able & (F.col("score") >= limit)
    # The row number comes last, so that even equal rows of any number are dealt over the partitions.
    ranked = global_rank(scored.filter(high), [F.desc("score"), F.asc_nulls_last("doc_id"), "_at"], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < wanted, F.col("rank") + 1))
    return ranked.unionByName(scored.filter(~F.coalesce(high, F.lit(False))).withColumn("rank", none)).drop("_at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, run: int = RUN, min_words: int = MIN_WORDS, seed: int = SEED,
             carry_text: bool = False) -> DataFrame:
    """Every document of ``docs`` with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null when it is not drawn) towards the texts of ``target``.

    Needs ``doc_id`` and ``text``; null and empty texts have no feature, weigh 0 and are never drawn, a null ``doc_id`` loses ties, repeated
    rows count and are drawn as often as they come, an empty ``target`` or ``docs`` is smoothed like any other (no document gives no row). Other columns
    are carried along, ``text`` only with ``carry_text`` (the table is stored on the way); input columns named like a result are replaced.
    """
    corpus, aim = keep(histogram(docs, run)), keep(histogram(target, run))
    gains = np.zeros(BUCKETS, np.int64)
    for r in bucket_gains(aim, corpus).collect():  # BUCKETS rows
        gains[r["bucket"]] = r["gain"]
    weighed = weigh(docs, gains, run, carry_text)
    scored = keep(weighed.withColumns({"score": F.col("weight") + noise(seed), "_at": F.monotonically_increasing_id()}))
    return draw(scored, percent, min_words)
