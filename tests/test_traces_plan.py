"""Traces sort the lines of a block once: no look ahead, and no sort for the join with what is carried into the blocks."""

from __future__ import annotations

import re

from linespark.operators.traces import group_traces


def test_lines_are_sorted_once_inside_their_blocks(spark):
    lines = spark.range(100).selectExpr("'a' AS source_id", "id AS line_num", "id AS ts_ns", "'System.err' AS tag",
                                        "'java.lang.KindException: x' AS message")
    plan = group_traces(lines, 16).emissions._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    assert not re.search(r"line_num#\d+L DESC", plan)


def test_the_closing_line_may_close_two_traces_and_have_no_time(spark):
    """A line of another tag ends a stderr trace that a fatal one interrupted, and the fatal one; its time is null."""
    rows = [("a", 0, 1, "System.err", "java.lang.OneException: x"), ("a", 1, 2, "AndroidRuntime", "FATAL EXCEPTION: main"),
            ("a", 2, 3, "AndroidRuntime", "Process: app.p, PID: 3"), ("a", 3, 4, "AndroidRuntime", "java.lang.TwoException: y"), ("a", 4, None, "Other", "end")]
    lines = spark.createDataFrame(rows, "source_id string, line_num long, ts_ns long, tag string, message string")
    for block in (1, 2, 3, 64):
        got = {(r.start_line, r.line_num, r.ts_ns, r.source, r.exception, r.fatal) for r in group_traces(lines, block).emissions.collect()}
        assert got == {(0, 4, None, "System.err", "java.lang.OneException", False), (1, 4, None, "app.p", "java.lang.TwoException", True)}
