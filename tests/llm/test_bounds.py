"""What the driver holds while it fits, and what the near-duplicate join fetches, on cases that showed the earlier growth."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from linespark.llm import language_id, parity_join


def test_svm_is_fitted_beside_its_rows():
    rng = np.random.default_rng(1)
    x, y = rng.random((3000, 1024), np.float32), np.where(np.arange(3000) % 2, 1.0, -1.0)
    tracemalloc.start()
    language_id.fit_svm(x, y, rounds=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < x.nbytes / 2


def random_set(rng, n):
    return np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))


def test_sketches_tell_long_strangers_apart_and_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (50, 700, 3000, 9000, 30_000):
        for m in (n, n * 9 // 10, n * 5 // 4):
            a, b = random_set(rng, n), random_set(rng, m)
            near = np.union1d(a[: n * 9 // 10], b[: n // 20])
            u, v = ([parity_join.parity_sketch(s)] for s in (a, b))
            sizes = lambda s: np.array([len(s)])
            assert not parity_join._may_link(parity_join._far(u, v), sizes(a), sizes(b), 80).any(), (n, m)
            assert parity_join._far(u, [parity_join.parity_sketch(near)])[0] <= len(np.setxor1d(a, near))


def test_pairs_of_several_widths_come_back_in_order_and_whole(spark):
    """Long near copies on both sides of a power of two, with strangers of the same lengths, in one large group."""
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    base, texts = words(1030), []
    for i in range(6):
        texts.append(" ".join(base[: 1030 - 9 * i] + words(4)))
        texts.append(" ".join(words(1030 - 9 * i)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = parity_join.sketches(docs, 5)
    widths = {len(r.sketch) for r in found.collect()}
    assert len(widths) == 2
    rows = docs.select(F.lit(7).cast("bigint").alias("key"), F.col("doc_id").alias("id"), F.col("doc_id").alias("cluster"), F.lit(12).cast("bigint").alias("n"))
    got = {(r.a, r.b) for r in parity_join._block_pairs(found, rows, 80, 5).distinct().collect()}
    sets = [parity_join.shingle_set(t.encode(), 5) for t in texts]
    linked = {(i, j) for i in range(12) for j in range(i + 1, 12) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert len(linked) == 15 and got == linked
    pairs = spark.createDataFrame([(i, j) for i in range(12) for j in range(i + 1, 12)], "a bigint, b bigint")
    assert {(r.a, r.b) for r in parity_join.verify(docs, found, pairs, 5, 80).collect()} == linked
