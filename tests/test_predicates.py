"""Predicates, extraction, templates: the cases of the inventory's fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linespark.functions import predicates as P
from linespark.functions import scalars as X
from linespark.functions.extract import all_groups, capture, extract_fields, matched, never_empty
from linespark.functions.levels import LEVELS, level_ord
from linespark.operators import aggregate, project
from linespark.operators.sections import with_section
from tests import folds

DAY = 86_400 * 10**9


def kept(df, cond):
    return [r.line_num for r in df.filter(cond).orderBy("line_num").collect()]


@pytest.fixture(scope="module")
def tagged(spark):
    return folds.lines(spark, [("s", i, i, t, f"text {i}") for i, t in enumerate(
        ["NetworkMonitor/102", "NetworkMonitor", "NetworkMonitorExtra", "networkmonitor", "Other"])])


def test_tag_prefix(tagged):
    assert kept(tagged, P.tag_prefix("NetworkMonitor")) == [0, 1, 2]
    assert kept(tagged, P.tag_prefix("NetworkMonitor/")) == [0]
    assert kept(tagged, P.tag_has("MONITOR")) == [0, 1, 2, 3]
    assert kept(tagged, P.search_condition("text", tags=["NetworkMonitor"])) == [1]
    assert kept(tagged, P.all_of(P.tag_regex("^N"), P.message_contains_any("1", "2"), P.message_regex(r"\d$"))) == [1, 2]


def test_level_min(spark):
    df = folds.lines(spark, [{"source_id": "s", "line_num": i + 1, "level": n, "level_ord": i} for i, n in enumerate(LEVELS)])
    assert kept(df, P.level_min("W")) == [4, 5, 6]
    assert kept(df, P.level_min("nonsense")) == [1, 2, 3, 4, 5, 6]
    assert kept(df, P.criteria(levels=["V", "Error"])) == [1, 5]
    ranks = spark.createDataFrame([("v",), ("Warning",), ("A",), ("?",)], "x string").select(level_ord("x").alias("r"))
    assert [r.r for r in ranks.collect()] == [0, 3, 5, 1]


def test_time_of_day(spark):
    df = folds.lines(spark, [("s", i, 19_000 * DAY + h * 3600 * 10**9, "", "") for i, h in enumerate((0, 1, 2, 3))] + [("s", 9, None, "", "")])
    assert kept(df, P.time_of_day("00:30", "02:00")) == [1, 2]
    assert kept(df, P.time_of_day("02:00", "00:30")) == []
    assert kept(df, P.search_condition(None, start_time="01:00", end_time="bad")) == [1, 2, 3]
    assert X.time_of_day_ns("12:30", None) == 45_000 * 10**9 and X.time_of_day_ns("x") == 0 and X.time_of_day_ns("x", None) is None


def test_criteria(spark):
    df = folds.lines(spark, [{"source_id": "s", "line_num": 0, "ts_ns": 5, "tag": "Net", "pid": 1, "message": "Hello"},
                             {"source_id": "s", "line_num": 1, "ts_ns": 50, "tag": "Disk", "pid": 2, "message": "hello WORLD"},
                             {"source_id": "s", "line_num": 2, "ts_ns": None, "tag": "x", "pid": 1, "message": "bye"}])
    assert kept(df, P.criteria()) == [0, 1, 2]
    assert kept(df, P.criteria(levels=[], tags=[], pids=[])) == [0, 1, 2]
    assert kept(df, P.criteria(text="HELLO")) == [0, 1]
    assert kept(df, P.criteria(time_start=5)) == [0, 1]
    assert kept(df, P.criteria(time_end=10)) == [0]
    assert kept(df, P.criteria(time_start=10, time_end=4, combine="or")) == [1]
    assert kept(df, P.criteria(text="world", pids=[1], combine="or")) == [0, 1, 2]
    assert kept(df, P.criteria(tags=["NE"], regex="^H")) == [0]
    with pytest.raises(ValueError):
        P.criteria(combine="xor")


def test_source_type(spark):
    df = folds.lines(spark, [{"source_id": "s", "line_num": i, "source_type": t} for i, t in enumerate(["Logcat", "Bugreport", "Dumpstate"])])
    assert kept(df, P.source_type_is("bugreport")) == [1, 2] and kept(df, P.source_type_is("DUMPSTATE")) == [2]


def test_innermost_section(spark):
    secs = spark.createDataFrame([("", i, n, a, b, p) for i, (n, a, b, p) in enumerate([
        ("SYSTEM LOG", 0, 99, None), ("DUMPSYS NORMAL", 100, 999, None), ("wifi", 200, 299, 1), ("thermalservice", 400, 499, 1)])],
        "source_id string, section_idx int, name string, start_line long, end_line long, parent_index int")
    at = {150: "DUMPSYS NORMAL", 199: "DUMPSYS NORMAL", 200: "wifi", 299: "wifi", 250: "wifi", 300: None, 350: None, 450: "thermalservice"}
    df = folds.lines(spark, [("", n, 0, "", "") for n in at])
    got = with_section(df, secs)
    assert {r.line_num: r.section for r in got.collect()} == at
    assert kept(got, P.section_is("wifi")) == [200, 250, 299]


def test_extract(spark):
    df = folds.lines(spark, [("s", 0, 0, "T1", "FD: 950 heap: 512"), ("s", 1, 0, "T2", "FD: x"), ("s", 2, 0, "T3", "k=")])
    got = extract_fields(df, {"fd": (r"FD:\s*(\S+)", "int"), "heap": (r"heap: (\d+)", "float"), "all": r"FD: \w+", "v": r"k=(\w*)"}, keep_raw=True)
    rows = [(r.fd, r.fd_raw, r.heap, r.all, r.v) for r in got.orderBy("line_num").collect()]
    assert rows == [(950, "950", 512.0, "FD: 950", None), (None, "x", None, "FD: x", None), (None, None, None, None, "")]
    caps = capture(df, r"T(\d)", r"FD: (\w)(\w*)").orderBy("line_num").collect()
    assert [(r.cap_1, r.cap_2, r.cap_3) for r in caps] == [("1", "9", "50"), ("2", "x", "")]
    assert never_empty(r"(\d+)x") and not never_empty(r"(\d*)x") and not never_empty(r"(?:a(b))?c") and never_empty("abc?")
    g = df.select(all_groups("message", r"^FD: (\w)(\w*)(.*)$").alias("g")).select(matched("g").alias("m"), F.col("g")).collect()
    assert [(r.m, r.g[1:]) for r in g if r.m] == [(True, ["9", "50", " heap: 512"]), (True, ["x", "", ""])]


def test_conditions_and_templates(spark):
    df = spark.createDataFrame([("7", None), ("junk", "a")], "n string, s string")
    got = df.select(P.condition(X.num("n") > 5).alias("big"), P.condition(F.col("s") != "b").alias("other"),
                    X.render_template("{{n}}/{{s}}/{{gone}}", {"n": F.col("n"), "s": F.col("s")}).alias("t")).collect()
    assert [(r.big, r.other, r.t) for r in got] == [(True, False, "7/<unknown>/<unknown>"), (False, True, "junk/a/<unknown>")]


def test_intervals():
    assert X.interval_ns("5m") == 300 * 10**9 and X.interval_ns("h") == 3600 * 10**9 and X.interval_ns("250ms") == 250_000_000
    with pytest.raises(ValueError):
        X.interval_ns("3 fortnights")


def test_display(spark):
    df = spark.createDataFrame([(850_000_000,), (12_340_000_000,), (245 * 10**9,), (7620 * 10**9,)], "ns long")
    assert [r[0] for r in df.select(X.duration_text("ns")).collect()] == ["850ms", "12.3s", "4m 05s", "2h 07m"]


def test_long_durations(spark):
    df = spark.createDataFrame([(850,), (245_000,), (514_285_542_857_200,)], "ms long")
    assert [r[0] for r in df.select(X.duration_text("ms", "ms")).collect()] == ["850ms", "4m 05s", "142857095h 14m"]


def test_highlight_quotes(spark):
    df = folds.lines(spark, [("s", 0, 0, "", "a.b A.B aXb"), ("s", 1, 0, "", "none")])
    got = project.highlight_spans(df, "a.b").orderBy("line_num").collect()
    assert [[(s.start, s.end) for s in r.spans] for r in got] == [[(0, 3), (4, 7)], []]


def test_top_map_entries(spark):
    df = spark.createDataFrame([("s", f"k{i:02d}", i) for i in range(25)], "source_id string, key string, n long")
    got = aggregate.top_map_entries(df, n=20).collect()
    assert len(got) == 20 and {r.total_keys for r in got} == {25} and min(r.n for r in got) == 5 and all(r.truncated for r in got)
