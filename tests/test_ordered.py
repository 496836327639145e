"""Ordered operators against the folds, on random lines and with blocks small enough to be crossed often."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from linespark.operators import charts, correlate as corr, ordered, sections, stateful, tracker
from linespark.operators.correlate import Source, correlate, correlation_matches
from linespark.operators.traces import group_traces
from tests import folds

HOT = 0.5


def random_lines(seed: int, n: int = 220, gap: int = 40):
    """Two sources, one with most of the lines; times never go back; ties happen."""
    rng = random.Random(seed)
    rows, at = [], {"a": (0, 0), "b": (0, 0)}
    for _ in range(n):
        src = "a" if rng.random() < 0.75 else "b"
        line, ts = at[src]
        line, ts = line + rng.randint(1, 4), ts + rng.choice([0, 0, rng.randint(1, gap)])
        at[src] = (line, ts)
        rows.append((src, line, ts * 1_000_000, rng.choice("xxxyz"), f"m{rng.randint(0, 9)}"))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_burst_equals_fold(spark, seed):
    rows = random_lines(seed)
    threshold, window = random.Random(seed).choice([(1, 30), (3, 60), (4, 25), (7, 200)])
    got = stateful.burst_detect(folds.lines(spark, rows), "tag", window, threshold, block_lines=16).collect()
    want = folds.bursts([(s, n, t, k) for s, n, t, k, _ in rows], window * 1_000_000, threshold)
    assert sorted((r.source_id, r.burst_key, r.count_in_window, r.line_num, r.ts_ns) for r in got) == sorted(want)


@pytest.mark.parametrize("window,threshold,gaps,count", [
    (2000, 5, [10] * 5, 1), (2000, 10, [10] * 5, 0), (2000, 3, [10] * 8, 1), (2000, 3, [10] * 3 + [5000] + [10] * 3, 2)])
def test_burst_cases(spark, window, threshold, gaps, count):
    ts, rows = 0, []
    for i, g in enumerate(gaps):
        ts += g
        rows.append(("s", i, ts * 1_000_000, "", "key=foo"))
    out = stateful.burst_detect(folds.lines(spark, rows), F.regexp_extract("message", r"key=(\w+)", 1), window, threshold).collect()
    assert len(out) == count
    if count:
        assert out[0].burst_key == "foo" and out[0].count_in_window == threshold


def test_burst_missing_key(spark):
    rows = [("s", i, i, "", "m") for i in range(3)]
    out = stateful.burst_detect(folds.lines(spark, rows), F.lit(None).cast("string"), 2000, 3).collect()
    assert [(r.burst_key, r.line_num) for r in out] == [("_default", 1)]


RULES = [("one", lambda r: r[4] in ("m1", "m2"), lambda r: {"a": r[4], "b": "x"}, ()),
         ("two", lambda r: r[4] == "m3", lambda r: {"b": "y"}, ("a",)),
         ("none", lambda r: r[4] == "m4", lambda r: {}, ()),
         ("three", lambda r: r[3] == "x" and r[4] in ("m4", "m5"), lambda r: {"c": "true"}, ()),
         ("reset", lambda r: r[4] == "m6", lambda r: {}, ("a", "b", "c"))]


def spark_rules():
    m = F.col("message")
    R = tracker.Rule
    return [R("one", m.isin("m1", "m2"), {"a": m, "b": "x"}), R("two", m == "m3", {"b": "y"}, ("a",)), R("none", m == "m4"),
            R("three", (F.col("tag") == "x") & m.isin("m4", "m5"), {"c": True}), R("reset", m == "m6", {}, ("a", "b", "c"))]


@pytest.mark.parametrize("seed", range(3))
def test_tracker_equals_fold(spark, seed):
    rows = random_lines(seed)
    tr = tracker.track_state(folds.lines(spark, rows), spark_rules(), {"a": None, "b": "", "c": False}, block_lines=16)
    got = [(r.source_id, r.line_num, r.transition, r.field, r.from_value, r.to_value) for r in tracker.flat_changes(tr).collect()]
    want = folds.transitions(rows, RULES, {"a": None, "b": "", "c": "false"})
    key = lambda t: tuple("" if v is None else str(v) for v in t)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_tracker_before_at_after(spark):
    rows = [("", n, n * 1000, t, m) for n, t, m in ((1, "Wifi", "ENABLED"), (5, "Info", "SSID=net"), (9, "Wifi", "DISABLED"), (10, "Other", "ENABLED"))]
    R = tracker.Rule
    rules = [R("on", (F.col("tag") == "Wifi") & F.col("message").contains("ENABLED"), {"enabled": True}),
             R("ssid", F.col("tag") == "Info", {"ssid": F.regexp_extract("message", r"SSID=(\w+)", 1)}),
             R("off", (F.col("tag") == "Wifi") & F.col("message").contains("DISABLED"), {"enabled": False}, ("ssid",))]
    defaults = {"enabled": False, "ssid": ""}
    lines = folds.lines(spark, rows)
    tr = tracker.track_state(lines, rules, defaults)
    points = spark.createDataFrame([("", n) for n in (0, 1, 4, 5, 8, 9, 50)], "source_id string, line_num long")
    got = {r.line_num: (r.enabled, r.ssid, sorted(r.initialized_fields)) for r in tracker.state_at(tr, points, defaults).collect()}
    both = ["enabled", "ssid"]
    assert got == {0: ("false", "", []), 1: ("true", "", ["enabled"]), 4: ("true", "", ["enabled"]), 5: ("true", "net", both),
                   8: ("true", "net", both), 9: ("false", "", both), 50: ("false", "", both)}
    snap = tracker.state_at(tr, points, defaults, mode="snapshot").collect()
    assert {(r.enabled, r.ssid) for r in snap} == {("false", "")} and len(snap) == 7


KINDS = {"t": lambda r: r[3] == "x" and r[4] in ("m0", "m1", "m2"), "c": lambda r: r[4] in ("m2", "m3"), "d": lambda r: r[3] == "y"}


def spark_sources():
    m, t = F.col("message"), F.col("tag")
    return {"t": Source("t", (t == "x") & m.isin("m0", "m1", "m2")), "c": Source("c", m.isin("m2", "m3")), "d": Source("d", t == "y")}


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("causes", [["c"], ["c", "d"]])
@pytest.mark.parametrize("trigger_first", [True, False])
def test_correlation_equals_fold(spark, seed, causes, trigger_first):
    rows = random_lines(seed)
    rng = random.Random(seed)
    wl, wm = rng.choice([None, 6, 40]), rng.choice([None, 30, 400])
    order = ["t", *causes] if trigger_first else [*causes, "t"]
    want = folds.correlations([(s, n, ts, {k for k in order if KINDS[k]((s, n, ts, tag, m))}) for s, n, ts, tag, m in rows], order, "t",
                              wl, None if wm is None else wm * 1_000_000)
    src = spark_sources()
    got = correlation_matches(folds.lines(spark, rows), src["t"], [src[c] for c in causes], wl, wm, trigger_first, block_lines=16)
    assert sorted((r.source_id, r.trigger_line, r.cause, r.line_num) for r in got.collect()) == sorted(want)


def test_correlation_long_chain(spark):
    """Overlapping windows without a sure restart: A B T A T B T A T ... in one source over many blocks."""
    kinds = ["c", "d"] + ["t", "c", "t", "d"] * 60
    rows = [("s", i, i, k, "m") for i, k in enumerate(kinds)]
    want = folds.correlations([(s, n, t, {k}) for s, n, t, k, _ in rows], ["t", "c", "d"], "t", None, None)
    t = F.col("tag")
    got = correlation_matches(folds.lines(spark, rows), Source("t", t == "t"), [Source("c", t == "c"), Source("d", t == "d")], block_lines=8)
    assert sorted((r.source_id, r.trigger_line, r.cause, r.line_num) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("rounds,fan", [(0, 2), (1, 3), (3, 2), (6, 2)])
def test_block_tables_compose(spark, rounds, fan):
    """Last firing before each block, over trees of several depths, against one walk a source; tables stay as small as the causes are few."""
    rng = random.Random(rounds)
    rows, want = [], set()
    for src, size in (("hot", 900), ("b", 40), ("one", 1)):
        seen, last, here = [0, 0, 0], -1, None
        for i in range(size):
            at = 10 + 7 * i + rng.randrange(5)
            for c in range(3):
                if rng.random() < (0.2, 0.5, 0.02)[c]:
                    seen[c] = at - rng.randrange(1, 5)
            if at // 64 != here:
                here = at // 64
                want.add((src, here, last))
            rows.append((src, here, at, min(seen)))
            if min(seen) > last:
                last = at
    able = spark.createDataFrame(rows, "source_id string, _block long, _at long, _m long")
    tables = able.groupBy("source_id", "_block").applyInPandas(corr._summed, corr.TABLE)
    assert {tuple(r) for r in corr._entered(tables, rounds, fan).collect()} == want
    above = tables.withColumn("_group", F.expr("_block div 8")).groupBy("source_id", "_group").applyInPandas(corr._composed, corr.TABLE)
    assert above.groupBy("source_id", "_block").count().agg(F.max("count")).first()[0] <= 4


def test_correlation_tree_equals_fold(spark, monkeypatch):
    monkeypatch.setattr(corr, "FAN", 2)
    monkeypatch.setattr(corr, "ROUNDS", 3)
    test_correlation_long_chain(spark)


@pytest.mark.parametrize("rows,lines,ms,events", [
    ([(1, "NON_TRIGGER"), (2, "TRIGGER"), (3, "TRIGGER")], None, None, 1),
    ([(1, "NON_TRIGGER"), (2, "TRIGGER"), (3, "TRIGGER"), (4, "NON_TRIGGER"), (5, "TRIGGER")], None, None, 2),
    ([(10, "NON_TRIGGER"), (20, "TRIGGER")], 5, None, 0), ([(10, "NON_TRIGGER"), (14, "TRIGGER")], 5, None, 1),
    ([(0, "NON_TRIGGER"), (10_000, "TRIGGER")], None, 5000, 0), ([(0, "NON_TRIGGER"), (3000, "TRIGGER")], None, 5000, 1)])
def test_correlation_cases(spark, rows, lines, ms, events):
    df = folds.lines(spark, [("", n, n * 1_000_000, "", m) for n, m in rows])
    m = F.col("message")
    out = correlate(df, Source("trig", m.contains("TRIGGER"), {"m": m}), [Source("cause", m.contains("NON_TRIGGER"), {"m": m})], lines, ms,
                    "{{trig.m}} after {{cause.m}} {{cause.gone}}")
    got = out.collect()
    assert len(got) == events
    if events:
        assert got[0].message == "TRIGGER after NON_TRIGGER {{cause.gone}}"


def test_no_causes_never_fires(spark):
    df = folds.lines(spark, [("", 1, 1, "", "x")])
    assert correlate(df, Source("t", F.lit(True)), []).count() == 0


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_pairs_and_gate(spark, block):
    rows = [("s", i, i * 10, t, "k") for i, t in enumerate("EssEsEEs")]
    t = F.col("tag")
    out = stateful.pair_events(folds.lines(spark, rows), "message", t == "s", t == "E", block_lines=block).orderBy("line_num").collect()
    assert [(r.line_num, r.start_line, r.latency) for r in out] == [(0, None, -1), (3, 2, 10), (5, 4, 10), (6, None, -1)]
    gate = stateful.gate_between(folds.lines(spark, rows), t == "s", t == "E", block_lines=block).orderBy("line_num").collect()
    assert [r.in_gate for r in gate] == [False, True, True, False, True, False, False, True]


def test_global_rank_within_hot_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("g"), ((F.col("id") * 7919) % 1009).alias("v"))
    got = {(r.g, r.v): r.rank for r in ordered.global_rank(df, ["v"], within=["g"], partitions=6).collect()}
    for g in ("hot", "cold"):
        vals = sorted(v for (h, v) in got if h == g)
        assert [got[(g, v)] for v in vals] == list(range(len(vals)))


@pytest.mark.parametrize("seed,n,total", [(1, 10, 200), (2, 25, 333), (3, 7, 8), (4, 50, 40), (5, 6, 3000), (6, 12, 5000)])
def test_lttb_equals_fold(spark, seed, n, total):
    rng = random.Random(seed)
    pts = [(i * 2, float(rng.randint(0, 30) if seed % 2 else rng.gauss(0, 5))) for i in range(total)]
    df = spark.createDataFrame([("s", x, y) for x, y in pts], "source_id string, line_num long, y double")
    got = sorted((r.x, r.y) for r in charts.lttb(df, n=n, block_lines=32).collect())
    want = folds.lttb(pts, n)
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_traces_equal_fold(spark, seed):
    rng = random.Random(seed)
    texts = [("FATAL EXCEPTION: main", {"thread": "main"}), ("Process: com.app, PID: 1", {"app": "com.app"}), ("Process: org.b, PID: 2", {"app": "org.b"}),
             ("java.lang.XException: a", {"exc": "java.lang.XException"}), ("at com.foo.bar.Baz.run", {"frame": "com.foo.bar"}),
             ("at java.util.deep.List.get", {"frame": "java.util.deep"}), ("Error nothing", {}),
             ("Caused by: java.io.YError: b", {"exc": "java.io.YError", "cause": "java.io.YError"})]
    rows, told = [], []
    for line in range(250):
        tag, (text, fields) = rng.choice(["AndroidRuntime", "AndroidRuntime", "System.err", "System.err", "Other"]), rng.choice(texts)
        rows.append(("s", line, line, tag, text))
        told.append((line, tag, fields))
    t = group_traces(folds.lines(spark, rows), block_lines=16)
    got = [(r.line_num, r.source, r.exception, r.root_cause, r.crash_thread, r.start_line, r.fatal) for r in t.emissions.collect()]
    want, table = folds.traces(told)
    assert sorted(got) == sorted(want)
    assert {r.app: r.detail for r in t.fatal.collect()} == table


def test_summarized_ranges(spark, tmp_path):
    rng = random.Random(7)
    points = [(str(n % 3), n) for n in rng.sample(range(2000), 900)]
    ranges = [(str(rng.randrange(4)), a, a + rng.choice([0, 3, 40, 900, 10**12])) for a in rng.sample(range(2100), 120)] + [("1", 5, 4)]
    spark.createDataFrame(points, "source_id string, line_num long").write.parquet(str(tmp_path / "points"))
    p = spark.read.parquet(str(tmp_path / "points"))
    r = spark.createDataFrame(ranges, "source_id string, start_line long, end_line long")
    held = {(s, a, b): [n for t, n in points if t == s and a <= n <= b] for s, a, b in ranges}
    got = sections.summarize_ranges(p, r, {"n": F.lit(1)}, {"last": F.col("line_num")}, block=16).collect()
    assert {(x.source_id, x.start_line, x.end_line): (x.n, x["last"]) for x in got} == {k: (len(v), max(v)) for k, v in held.items() if v}
    rows = sections.over_ranges(p, r, block=16)
    assert sorted(map(tuple, rows.select("source_id", "start_line", "end_line", "line_num").collect())) == sorted(
        (*k, n) for k, v in held.items() for n in v)
    # A small file's points, repeated for each level, are many rows: no plan may broadcast them on the size of the file.
    plan = rows._jdf.queryExecution().sparkPlan().toString().split("\n")
    assert not [x for x in plan if "BroadcastHashJoin" in x and "_lvl" in x]
