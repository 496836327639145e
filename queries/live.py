"""Streaming forms, run over all input that is there and read back from their sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linespark.functions import predicates as P
from linespark.functions.extract import extract_fields, field
from linespark.operators import aggregate as A
from linespark.operators import tracker
from linespark.operators.ordered import ensure_checkpoint_dir
from linespark.streaming import live, stateful
from linespark.streaming.fenced import read_committed

from .adapters import LINES, doc_lines, event_lines, lines_of, table, with_event_parts, with_lines
from .ordered import BURST, CORR, DEFAULTS, HOUR_MS, TRACK, corr_sources, tracker_rules
from .registry import query


def stream_of_events(spark, sf):
    batch = table(spark, sf, "events")
    return lines_of(with_event_parts(spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)))


def places(spark) -> tuple[str, str]:
    """Fresh sink and checkpoint folders in the shared folder."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


@query("stream_emit", with_lines("SELECT source_id, line_num, ts_ns, cents FROM lines WHERE tag = 'purchase'"))
def stream_emit(spark, sf):
    x = extract_fields(stream_of_events(spark, sf), {"cents": (r"cents=(\d+)", "int")})
    return live.run_available(live.stream_emit(x, F.col("tag") == "purchase", cents=F.col("cents")), *places(spark))


@query("stream_filter_transform", with_lines("SELECT source_id, line_num, regexp_replace(message, '\\d', '#', 'g') AS message FROM lines WHERE contains(raw, 'user=4')"))
def stream_filter_transform(spark, sf):
    x = live.stream_filter(stream_of_events(spark, sf), P.criteria(text="USER=4"))
    return live.run_available(live.stream_transform(x, message=F.regexp_replace("message", r"\d", "#")).select(
        "source_id", "line_num", "message"), *places(spark))


@query("stream_summarize", with_lines("""
SELECT source_id, count(*) AS events, count(*) FILTER (tag = 'error') AS errors, arg_max(tag, line_num) AS last_tag FROM lines GROUP BY 1"""))
def stream_summarize(spark, sf):
    return live.run_totals(live.stream_summarize(stream_of_events(spark, sf), {
        "events": A.counter(), "errors": A.counter(F.col("tag") == "error"), "last_tag": A.last_value("tag")}), *places(spark))


@query("stream_watch", with_lines("""
SELECT 'bad' AS watch, count(*) AS total FROM lines WHERE level_ord >= 4 UNION ALL SELECT 'nine', count(*) FROM lines WHERE contains(raw, 'user=9')"""))
def stream_watch(spark, sf):
    return live.run_totals(live.stream_watch(stream_of_events(spark, sf), {"bad": P.level_min("E"), "nine": P.criteria(text="user=9")}), *places(spark))


@query("stream_metadata", with_lines("""
SELECT source_id, count(*) AS total_lines, sum(strlen(raw) + 1)::BIGINT AS bytes, arg_min(ts_ns, line_num) AS first_ts_ns, max(ts_ns) AS last_ts_ns
FROM lines GROUP BY 1"""))
def stream_metadata(spark, sf):
    return live.run_totals(live.stream_metadata(stream_of_events(spark, sf)), *places(spark))


@query("stream_count_by_time", with_lines("""
, b AS (SELECT tag, ts_ns - ts_ns % 86400000000000 AS bucket, count(*) AS n FROM lines GROUP BY 1, 2)
SELECT * FROM b WHERE bucket + 86400000000000 <= (SELECT max(ts_ns) // 1000000 * 1000000 FROM lines) - 7200000000000"""))
def stream_count_by_time(spark, sf):
    return live.run_available(live.stream_count_by_time(stream_of_events(spark, sf), "1d", "2 hours", "tag"), *places(spark))


@query("stream_burst", f"""WITH {LINES}, {BURST.format(w=24 * HOUR_MS * 10**6, t=20)}
SELECT source_id, tag AS burst_key, cnt AS count_in_window, CAST({24 * HOUR_MS} AS BIGINT) AS window_ms, line_num, ts_ns
FROM h WHERE hot AND NOT was""")
def stream_burst(spark, sf):
    return live.run_available(stateful.stream_burst(stream_of_events(spark, sf), "tag", 24 * HOUR_MS, 20), *places(spark))


@query("stream_track", f"WITH {LINES}, {TRACK} SELECT source_id, line_num, ts_ns, transition, field, from_value, to_value FROM tr")
def stream_track(spark, sf):
    out = live.run_available(stateful.stream_track(stream_of_events(spark, sf), tracker_rules(), DEFAULTS, "shop"), *places(spark))
    return tracker.flat_changes(out).select("source_id", "line_num", "ts_ns", "transition", "field", "from_value", "to_value")


@query("stream_correlate", f"""WITH {LINES}, {CORR}
SELECT source_id, trigger_line, count(*) AS matches, 'user ' || any_value(t_pid) || ' after ' || arg_max(c_pid, line_num) AS message FROM m GROUP BY 1, 2""")
def stream_correlate(spark, sf):
    trigger, cause = corr_sources()
    out = stateful.stream_correlate(stream_of_events(spark, sf), trigger, [cause], 40, 3 * HOUR_MS, "user {{err.user}} after {{buy.user}}")
    return live.run_available(out, *places(spark)).select("source_id", "trigger_line", "matches", "message")


@query("stream_mask", with_lines("""
SELECT source_id, line_num, replace(message, 'user=', 'user=<PII>') AS message FROM (SELECT source_id, line_num, regexp_replace(message, 'user=\\d+', 'user=') AS message FROM lines)"""))
def stream_mask(spark, sf):
    """User numbers masked as a custom kind of value; the token numbers are taken out for comparison."""
    out, state = places(spark)
    live.stream_mask(stream_of_events(spark, sf), f"{state}-map", out, state, available_now=True, categories=(),
                     custom={"PII": r"(?<=user=)\d+"}).awaitTermination()
    return spark.read.parquet(out).select("source_id", "line_num", F.regexp_replace("message", r"<PII-\d+>", "<PII>").alias("message"))


LATE_DELAY = "9 days"


def late_parts(spark, sf):
    """The events in four parts by day of month; every tenth event comes one part late."""
    e = table(spark, sf, "events")
    part = F.least(F.lit(3), F.expr("(day(ts) - 1) div 8") + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    return [e.filter(part == i) for i in range(4)]


def late_events(spark, sf, base):
    """The parts as a stream of the folders below ``base``."""
    schema = table(spark, sf, "events").schema
    return lines_of(with_event_parts(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(base)))


def run_late(spark, sf, run):
    """Write the parts one after the other and let ``run(stream, sink, checkpoint)`` take up each when it is there: a part is one micro-batch,
    however many files it has, so no row is more than a part late."""
    (base, _), (out, state) = places(spark), places(spark)
    for i, part in enumerate(late_parts(spark, sf)):
        part.write.parquet(f"{base}/p{i}")
        result = run(late_events(spark, sf, base), out, state)
    return result


def passed(matched: str, ts: str = "ts_ns") -> str:
    """Rows that the last watermark has passed: the latest matched time less the delay, in whole milliseconds."""
    return f"{ts} < (SELECT max(ts_ns) // 1000000 * 1000000 - {9 * 24 * HOUR_MS * 10**6} FROM {matched})"


@query("stream_burst_late", f"""WITH {LINES}, {BURST.format(w=24 * HOUR_MS * 10**6, t=20)}
SELECT source_id, tag AS burst_key, cnt AS count_in_window, line_num, ts_ns FROM h WHERE hot AND NOT was AND {passed('lines')}""")
def stream_burst_late(spark, sf):
    """Rows that come a batch late give the batch result, as far as the watermark has passed."""
    out = run_late(spark, sf, lambda x, *at: live.run_available(stateful.stream_burst(x, "tag", 24 * HOUR_MS, 20, delay=LATE_DELAY), *at))
    return out.select("source_id", "burst_key", "count_in_window", "line_num", "ts_ns")


@query("stream_track_late", f"""WITH {LINES}, {TRACK} SELECT source_id, line_num, ts_ns, transition, field, from_value, to_value FROM tr
WHERE {passed('(SELECT ts_ns FROM r WHERE rule IS NOT NULL)')}""")
def stream_track_late(spark, sf):
    out = run_late(spark, sf, lambda x, *at: live.run_available(stateful.stream_track(x, tracker_rules(), DEFAULTS, "shop", delay=LATE_DELAY), *at))
    return tracker.flat_changes(out).select("source_id", "line_num", "ts_ns", "transition", "field", "from_value", "to_value")


@query("stream_correlate_late", f"""WITH {LINES}, {CORR}
SELECT source_id, trigger_line, count(*) AS matches FROM m JOIN x ON x.source_id = m.source_id AND x.line_num = m.trigger_line AND x.trig
WHERE {passed('x', 'x.ts_ns')} GROUP BY ALL""".replace("SELECT source_id, trigger_line, count", "SELECT m.source_id, trigger_line, count"))
def stream_correlate_late(spark, sf):
    trigger, cause = corr_sources()
    out = run_late(spark, sf, lambda x, *at: live.run_available(
        stateful.stream_correlate(x, trigger, [cause], 40, 3 * HOUR_MS, delay=LATE_DELAY), *at))
    return out.select("source_id", "trigger_line", "matches")


@query("stream_new_matches", with_lines("""
SELECT 'bad' AS watch, count(*) AS total FROM lines WHERE level_ord >= 4 UNION ALL SELECT 'nine', count(*) FROM lines WHERE contains(raw, 'user=9')"""))
def stream_new_matches(spark, sf):
    """New matches of every micro-batch, added up."""
    def run(x, out, state):
        live.stream_new_matches(x, {"bad": P.level_min("E"), "nine": P.criteria(text="user=9")}, out, state, available_now=True).awaitTermination()
        return out
    out = run_late(spark, sf, run)
    return spark.read.option("recursiveFileLookup", "true").parquet(out).groupBy("watch").agg(F.sum("new").alias("total"))


@query("stream_restart", with_lines("SELECT source_id, line_num, tag FROM lines WHERE tag = 'purchase'"))
def stream_restart(spark, sf):
    """Two starts into one sink under other rules, the second one twice: readers see the newest rules' rows, once."""
    out, state = places(spark)
    for tag in ("error", "purchase", "purchase"):
        rows = live.stream_filter(stream_of_events(spark, sf), F.col("tag") == tag).select("source_id", "line_num", "tag")
        live.start_stream(rows, out, state, "watch", (tag,)).awaitTermination()
    return read_committed(spark, out)
