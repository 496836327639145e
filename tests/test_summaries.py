"""Bursts on any times, bracket matching, ranges over whole sources and exact percentiles, against folds over plain rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from linespark.operators import aggregate, sections, stateful
from linespark.operators.joins import with_annotations
from tests import folds


@pytest.mark.parametrize("seed", range(6))
def test_burst_with_times_that_go_backwards(spark, seed):
    rng = random.Random(seed)
    rows, line = [], {"a": 0, "b": 0}
    for _ in range(260):
        src = "a" if rng.random() < 0.8 else "b"
        line[src] += rng.randint(1, 3)
        drift = line[src] if rng.random() < 0.7 else rng.randint(-60, 200)
        rows.append((src, line[src], (drift + rng.randint(-25, 25)) * 1_000_000, rng.choice("xxy"), "m"))
    threshold, window = rng.choice([(1, 5), (2, 4), (3, 10), (5, 30), (8, 60)])
    want = folds.bursts([(s, n, t, k) for s, n, t, k, _ in rows], window * 1_000_000, threshold)
    got = stateful.burst_detect(folds.lines(spark, rows), "tag", window, threshold, block_lines=8).collect()
    assert sorted((r.source_id, r.burst_key, r.count_in_window, r.line_num, r.ts_ns) for r in got) == sorted(want)


def brackets(marks):
    """Pairs by a stack for each source and name; marks in line order: (source, line, name, opens)."""
    stacks, out = {}, []
    for src, line, name, opens in marks:
        stack = stacks.setdefault((src, name), [])
        if opens:
            stack.append(line)
        elif stack:
            out.append((src, name, stack.pop(), line))
    return out


@pytest.mark.parametrize("seed,block", [(1, 4), (2, 16), (3, 1 << 18)])
def test_matched_pairs_equal_stacks(spark, seed, block):
    rng = random.Random(seed)
    marks = [(rng.choice("aab"), n, rng.choice(["N", "N", "M"]), rng.random() < 0.5) for n in range(300)]
    df = spark.createDataFrame(marks, "source_id string, line_num long, name string, opens boolean")
    got = sections.matched_pairs(df, ["source_id", "name"], F.col("opens"), block)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brackets(marks))


def test_one_name_repeated_many_times(spark):
    n = 100_000
    df = spark.range(2 * n).select(F.lit("s").alias("source_id"), F.col("id").alias("line_num"), F.lit("same").alias("name"),
                                   F.when(F.col("id") < 500, F.lit(True)).when(F.col("id") >= 2 * n - 500, F.lit(False)).otherwise(F.col("id") % 2 == 0).alias("opens"))
    pairs = sections.matched_pairs(df, ["source_id", "name"], F.col("opens"), block_lines=4096)
    got = pairs.agg(F.count("*").alias("n"), F.sum(F.col("end_line") - F.col("start_line")).alias("d"), F.max(F.col("end_line") - F.col("start_line")).alias("widest")).first()
    assert (got.n, got.widest) == (n, 2 * n - 1)
    assert got.d == (n - 500) + sum(2 * n - 1 - 2 * i for i in range(500))


def test_sections_of_one_repeated_name(spark):
    raw = [f"------ X ({i}) ------" if i % 3 else "------ 0.1s was the duration of 'X' ------" for i in range(60)]
    df = spark.createDataFrame([("s", i, r) for i, r in enumerate(raw)], "source_id string, line_num long, raw string")
    want = brackets([("s", i, "X", "duration" not in r) for i, r in enumerate(raw)])
    got = sections.build_sections(df, block_lines=4)
    assert sorted((r.source_id, r.name, r.start_line, r.end_line) for r in got.collect()) == sorted(want)


def test_dyadic_nodes_make_up_the_range(spark):
    rng = random.Random(4)
    ranges = [("s", i, a, a + rng.choice([0, 1, 5, 300, 100_000])) for i, a in enumerate(rng.randint(0, 3000) for _ in range(200))] + [("s", 999, 0, (1 << 40) - 1), ("s", 1000, 7, 6)]
    df = spark.createDataFrame(ranges, "source_id string, i int, start_line long, end_line long")
    nodes = {}
    for r in sections.dyadic(df, "start_line", "end_line", 4).collect():
        nodes.setdefault(r.i, []).append((r._node << r._lvl, (r._node + 1) << r._lvl))
    for _, i, a, b in ranges:
        got, at = sorted(nodes.get(i, [])), a // 4
        assert len(got) <= 2 * max(1, math.log2(max(2, (b - a) // 4 + 2))) + 2
        for lo, hi in got:  # side by side, without a gap
            assert lo == at
            at = hi
        assert a > b or at == b // 4 + 1


@pytest.mark.parametrize("block", [4, 1 << 14])
def test_nested_ranges_equal_all_comparisons(spark, block):
    rng = random.Random(block)
    secs = [(rng.choice("ab"), i, f"n{i}", a, a + rng.choice([0, 3, 40, 5000])) for i, a in enumerate(rng.randint(0, 400) for _ in range(40))] + [("a", 77, "all", 0, 10**9)]
    points = [(rng.choice("abc"), rng.randint(0, 700)) for _ in range(150)]
    points = sorted(set(points))
    lines = spark.createDataFrame([(s, n, "m") for s, n in points], "source_id string, line_num long, message string")
    df = spark.createDataFrame(secs, "source_id string, section_idx int, name string, start_line long, end_line long")
    want = sorted((s, n, i) for s, n in points for src, i, _, a, b in secs if s == src and a <= n <= b)
    assert sorted((r.source_id, r.line_num, r.section_idx) for r in sections.containing_sections(lines, df, block).collect()) == want
    assert sorted((r.source_id, r.line_num, r.section_idx) for r in with_annotations(lines, df).collect()) == want
    assert sections.containing_sections(lines, df.limit(0), block).count() == 0 and sections.containing_sections(lines.limit(0), df, block).count() == 0


def disc(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(p * len(values))) - 1] if values else None


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_percentiles(spark, accuracy):
    rng = random.Random(accuracy)
    rows = [(rng.choice(["hot"] * 8 + ["x", "y", None]), rng.choice([None, 5.0, rng.gauss(0, 1), float(rng.randint(0, 9)), 10 ** rng.uniform(-300, 300)])) for _ in range(3000)] + [("none", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    ps = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = aggregate.exact_percentiles(df, [F.col("g")], {f"p{i}": (F.col("v"), p) for i, p in enumerate(ps)}, accuracy)
    by = {}
    for g, v in rows:
        by.setdefault(g, []).extend([] if v is None else [v])
    assert {r.g: tuple(r)[1:] for r in got.collect()} == {g: tuple(disc(vs, p) for p in ps) for g, vs in by.items() if vs}


def test_percentile_among_other_aggregates(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("a", "3"), ("b", None), (None, "7")], "g string, v string")
    got = {r.g: (r["count"], r.p50_v, r.p90_v) for r in aggregate.aggregate(df, [("count",), ("percentile", "v"), ("percentile", "v", 0.9)], "g").collect()}
    assert got == {"a": (3, 1.0, 3.0), "b": (1, None, None), None: (1, 7.0, 7.0)}
    assert [tuple(r) for r in aggregate.aggregate(df, [("percentile", "v")]).collect()] == [(3.0,)]
    assert [tuple(r) for r in aggregate.aggregate(df.limit(0), [("percentile", "v")]).collect()] == [(None,)]


def test_percentile_of_many_distinct_values(spark):
    n = 2_000_000
    df = spark.range(n).select(F.lit("hot").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    r = aggregate.aggregate(df, [("percentile", "v", 0.5), ("percentile", "v", 0.999)], "g").first()
    assert (r.p50_v, r.p100_v) == (n // 2 - 1, math.ceil(0.999 * n) - 1)
