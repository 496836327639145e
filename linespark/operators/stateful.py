"""Bursts, carried values, pairing and change detection over ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import NS_PER_MS, as_col
from .ordered import BLOCK_LINES, halo, look_back, scan

DEFAULT_KEY = "_default"


def burst_detect(df: DataFrame, key: Column | str, window_ms: int = 2000, threshold: int = 20,
                 line: str = "previous", block_lines: int = BLOCK_LINES) -> DataFrame:
    """Rising edges of a per-key sliding count.

    The window is a queue: an event first drops events from its front while they are more than
    ``window_ms`` older, then joins it, and is hot when the queue has ``threshold`` events; a burst
    row is written where heat starts, where the count is the threshold itself. Times may go
    backwards. What is left in front is then the first event whose *running maximum* of
    times reaches the event's running maximum less the window: an event drops all that
    an earlier event with a later time had dropped, and no event before a new maximum can hold
    the front for it. So an event is hot when the running maximum has grown by at most
    the window over the last ``threshold`` events, and maxima compose over blocks.
    ``line="previous"`` reports the preceding matched line of the source, of any key;
    ``"current"`` the line that completed the burst.
    """
    if threshold < 1 or line not in ("previous", "current"):
        raise ValueError("threshold must be >= 1 and line 'previous' or 'current'")
    width = window_ms * NS_PER_MS
    keyed = df.select("source_id", "line_num", F.coalesce("ts_ns", F.lit(0)).alias("ts_ns"),
                      F.coalesce(as_col(key).cast("string"), F.lit(DEFAULT_KEY)).alias("burst_key"))
    if line == "previous":
        keyed = scan(keyed, prev={"_shown": F.col("line_num")}, block_lines=block_lines)
    else:
        keyed = keyed.withColumn("_shown", F.col("line_num"))
    by = ("source_id", "burst_key")
    ranked = scan(keyed, keys=by, before={"_rank": F.lit(1).cast("bigint")}, peak={"_peak": F.col("ts_ns")}, block_lines=block_lines)
    ranked = ranked.withColumn("_peak", F.greatest("_peak", "ts_ns"))
    near = halo(ranked, position="_rank", before=threshold, block_lines=block_lines)
    w = W.partitionBy(*by, "_block").orderBy("_rank")
    hot = F.coalesce(F.col("_peak") - F.lag("_peak", threshold - 1).over(w) <= width, F.lit(False))
    was = F.coalesce(F.lag("_peak", 1).over(w) - F.lag("_peak", threshold).over(w) <= width, F.lit(False))
    edges = near.withColumns({"_hot": hot, "_was": was}).filter("_own AND _hot AND NOT _was")
    return edges.select("source_id", "burst_key", F.lit(threshold).cast("bigint").alias("count_in_window"),
                        F.lit(window_ms).cast("bigint").alias("window_ms"),
                        F.coalesce("_shown", F.lit(0)).alias("line_num"), "ts_ns")


def carry_forward(df: DataFrame, col: Column | str, name: str, keys=("source_id",), order=("line_num",),
                  block_lines: int = BLOCK_LINES) -> DataFrame:
    """Most recent non-NULL value up to and including each row."""
    return scan(df, keys=keys, order=order, last={name: as_col(col)}, block_lines=block_lines)


def gate_between(df: DataFrame, start: Column, stop: Column, name: str = "in_gate", keys=("source_id",),
                 block_lines: int = BLOCK_LINES) -> DataFrame:
    """True from a start marker until a stop marker; the stop line itself is outside."""
    mark = F.when(stop, F.lit(False)).when(start, F.lit(True))
    out = scan(df, keys=keys, last={name: mark}, block_lines=block_lines)
    return out.withColumn(name, F.coalesce(name, F.lit(False)))


def pair_events(df: DataFrame, key: Column | str, start: Column, end: Column, ts: Column | str = "ts_ns",
                block_lines: int = BLOCK_LINES) -> DataFrame:
    """One row per end event with its start and the latency; -1 when there is no open start.

    A new start replaces the pending one, and an end consumes it.
    """
    base = df.withColumns({"pair_key": as_col(key), "_ts": as_col(ts),
                           "_kind": F.when(start, F.lit("S")).when(end, F.lit("E"))})
    base = base.filter(F.col("_kind").isNotNull() & F.col("pair_key").isNotNull())
    seen = scan(base, keys=("source_id", "pair_key"), block_lines=block_lines,
                prev={"_prev": F.struct(F.col("_kind").alias("kind"), F.col("_ts").alias("ts"),
                                        F.col("line_num").alias("line"))})
    ends = seen.filter(F.col("_kind") == "E")
    paired = F.coalesce(F.col("_prev.kind") == "S", F.lit(False))
    return ends.withColumns({
        "start_line": F.when(paired, F.col("_prev.line")),
        "latency": F.when(paired, F.col("_ts") - F.col("_prev.ts")).otherwise(F.lit(-1)),
    }).drop("_prev", "_kind", "_ts")


def running_avg(df: DataFrame, key: Column | str, x: Column | str, name: str = "running_avg",
                block_lines: int = BLOCK_LINES) -> DataFrame:
    """Average of ``x`` per key over all rows so far, this one included."""
    base = df.withColumns({"_key": as_col(key), "_x": as_col(x)}).filter(F.col("_key").isNotNull())
    present = F.when(F.col("_x").isNotNull(), 1).otherwise(0)
    out = scan(base, keys=("source_id", "_key"), block_lines=block_lines,
               before={"_sum": F.coalesce("_x", F.lit(0)), "_cnt": present})
    n = F.col("_cnt") + present
    total = F.col("_sum") + F.coalesce("_x", F.lit(0))
    return out.withColumn(name, F.when(n > 0, total / n)).drop("_key", "_x", "_sum", "_cnt")


def on_change(df: DataFrame, key: Column | str, col: Column | str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Rows at which the value differs from the previous row of the same key; the first row counts."""
    base = df.withColumns({"_key": as_col(key), "_v": F.struct(as_col(col).alias("v"))})
    base = base.filter(F.col("_key").isNotNull())
    out = scan(base, keys=("source_id", "_key"), prev={"_pv": F.col("_v")}, block_lines=block_lines)
    return out.filter(~F.col("_v").eqNullSafe(F.col("_pv"))).drop("_key", "_v", "_pv")


def lookback(df: DataFrame, n: int = 1000, columns=("line_num", "message"), name: str = "history",
             block_lines: int = BLOCK_LINES) -> DataFrame:
    """Up to ``n`` preceding matched lines as an array of structs, most recent first."""
    return look_back(df, n, {name: F.struct(*columns)}, block_lines=block_lines)


def lookback_extract(df: DataFrame, trigger: Column, match: Column, max_lines: int, field: Column,
                     name: str = "found", block_lines: int = BLOCK_LINES) -> DataFrame:
    """For each trigger line, ``field`` of the nearest earlier matching line within ``max_lines`` lines."""
    kept = df.withColumns({"_trigger": F.coalesce(trigger, F.lit(False)), "_hit": F.coalesce(match, F.lit(False))})
    kept = kept.filter(F.col("_trigger") | F.col("_hit"))
    found = F.when(F.col("_hit"), F.struct(F.col("line_num").alias("line"), field.alias("v")))
    out = scan(kept, prev={"_found": found}, block_lines=block_lines).filter("_trigger")
    ok = F.col("line_num") - F.col("_found.line") <= max_lines
    return out.withColumns({name: F.when(ok, F.col("_found.v")),
                            f"{name}_line": F.when(ok, F.col("_found.line"))}).drop("_trigger", "_hit", "_found")


def delta_between(df: DataFrame, seq: Column, a, b, x: Column | str, keys=("source_id",)) -> DataFrame:
    """Value of ``x`` at the first row of step ``b`` minus that at the first row of step ``a``, if later."""
    base = df.withColumns({"_seq": seq, "_x": as_col(x)})
    first = lambda step: F.min_by(F.struct("line_num", "_x"), F.when(F.col("_seq") == F.lit(step), F.col("line_num")))
    two = base.filter(F.col("_seq").isin(a, b)).groupBy(*keys).agg(first(a).alias("_a"), first(b).alias("_b"))
    later = F.col("_b.line_num") > F.col("_a.line_num")
    return two.select(*keys, F.when(later, F.col("_b._x") - F.col("_a._x")).alias("delta"))
