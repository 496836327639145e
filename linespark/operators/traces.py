"""Stack-trace grouping over ordered lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.extract import field
from .ordered import BLOCK_LINES

# Line shapes of fatal and plain traces, and package prefixes that are not application code.
FATAL_THREAD = r"FATAL EXCEPTION:\s+(.+)"
PROCESS_NAME = r"Process:\s+([^\s,]+)"
EXCEPTION_CLASS = r"([a-z][\w.]*\.(?:\w+(?:Exception|Error|Throwable)))"
CAUSED_BY = r"Caused by:\s+([a-z][\w.]*\.(?:\w+(?:Exception|Error|Throwable)))"
FRAME_PACKAGE = r"^\s*at\s+([a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_$]*){2,})\.[A-Z]"
FRAMEWORK = ("java.", "javax.", "android.", "com.android.", "libcore.", "sun.", "dalvik.", "kotlin.", "androidx.")
FATAL_TAG, STDERR_TAG = "AndroidRuntime", "System.err"


@dataclass(frozen=True)
class Traces:
    """``emissions`` (one per closed trace or single exception), ``fatal`` (last detail per app),
    ``counts`` (fatal and non-fatal openers), ``nonfatal`` (reported non-fatal traces by source and class)."""

    emissions: DataFrame
    fatal: DataFrame
    counts: DataFrame
    nonfatal: DataFrame


def _staged(df: DataFrame) -> DataFrame:
    """The extracted fields of each line; what it does follows from them (:func:`_marks`)."""
    return df.select("source_id", "line_num", "ts_ns", "tag",
                     field(FATAL_THREAD).alias("thread"), field(PROCESS_NAME).alias("app"),
                     field(EXCEPTION_CLASS).alias("exc"), field(CAUSED_BY).alias("cause"),
                     field(FRAME_PACKAGE).alias("frame"))


def _marks() -> tuple[Column, Column, Column, Column]:
    """Whether a line opens a fatal trace, may be taken by an open one, is of the stderr tag, and may open a stderr trace."""
    opens = F.col("thread").isNotNull()
    stderr = F.coalesce(F.col("tag") == STDERR_TAG, F.lit(False))
    head = stderr & F.col("exc").isNotNull() & F.col("cause").isNull()
    absorbs = ~opens & (F.col("app").isNotNull() | F.coalesce(F.col("tag") == FATAL_TAG, F.lit(False)))
    return opens, absorbs, stderr, head


def _traced(df: DataFrame, block_lines: int) -> DataFrame:
    """Each line for the trace it belongs to (``_kind``, ``_start``), and again for each trace that it closes (``_closes``, no ``_kind``).

    Whether a line is inside a trace depends only on the latest mark before it, but a line that a fatal trace takes does
    nothing to a stderr trace. Inside a block this is open only for the absorbable lines before the block's first fatal
    mark, so a block is summed up with those lines (``early``) and without them, and the state carried into the block says
    which it is. Rows are shuffled once, and sorted once inside their block: the end of a trace is told by the line that
    closes it, so nothing looks ahead.
    """
    x = _staged(df)
    rest = [c for c in x.columns if c != "source_id"]
    packed = (x.withColumn("_block", F.expr(f"line_num div {int(block_lines)}L")).filter("source_id IS NOT NULL AND _block IS NOT NULL")
              .select("source_id", "_block", F.array(F.struct(*rest)).alias("_row")).repartition("source_id", "_block"))
    inside = W.partitionBy("source_id", "_block").orderBy("line_num").rowsBetween(W.unboundedPreceding, -1)
    latest = lambda c, w: F.last(c, ignorenulls=True).over(w)
    line = lambda c: F.when(c, F.col("line_num"))
    opens, absorbs, stderr, head = _marks()
    mark, mark2 = ~absorbs, ~opens & (head | ~stderr)

    rows = packed.select("source_id", "_block", F.inline("_row")).withColumn("_open", latest(F.when(mark, opens), inside))
    early = absorbs & F.col("_open").isNull()
    sure = ~early & ~(absorbs & F.col("_open"))
    last = lambda name, opening, c: (F.max_by(opening, line(c)).alias(f"{name}_open"), F.max(line(c)).alias(f"{name}_line"))
    blocks = rows.groupBy("source_id", "_block").agg(*last("_last", opens, mark), *last("_sure", head, mark2 & sure), *last("_early", head, mark2 & early))
    earlier = W.partitionBy("source_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumns({"_into_open": latest("_last_open", earlier), "_into_line": latest("_last_line", earlier)})
    free = ~F.coalesce("_into_open", F.lit(False))
    blocks = blocks.withColumns({f"_last2_{c}": F.coalesce(f"_sure_{c}", F.when(free, F.col(f"_early_{c}"))) for c in ("open", "line")})
    carry = blocks.select("source_id", "_block", "_into_open", "_into_line", latest("_last2_open", earlier).alias("_into2_open"),
                          latest("_last2_line", earlier).alias("_into2_line"))

    # One row a block on the hinted side; a sort merge join would sort the lines once more.
    seen = packed.join(carry.hint("shuffle_hash"), ["source_id", "_block"]).select(
        "source_id", "_block", "_into_open", "_into_line", "_into2_open", "_into2_line", F.inline("_row"))
    seen = seen.withColumns({"_open": F.coalesce(latest(F.when(mark, opens), inside), "_into_open", F.lit(False)),
                             "_line": F.coalesce(latest(line(mark), inside), "_into_line")})
    taken = opens | (absorbs & F.col("_open"))
    mark2 = ~taken & (head | ~stderr)
    seen = seen.withColumns({"_open2": F.coalesce(latest(F.when(mark2, head), inside), "_into2_open", F.lit(False)),
                             "_line2": F.coalesce(latest(line(mark2), inside), "_into2_line")})
    single = ~stderr & F.col("exc").isNotNull() & F.col("cause").isNull() & F.col("frame").isNull()
    kind = F.when(taken, "fatal").when(head | (stderr & F.col("_open2")), "stderr").when(single, "single")
    start = F.when(opens | (~taken & (head | single)), F.col("line_num")).when(taken, F.col("_line")).otherwise(F.col("_line2"))
    role = lambda c, start, kind: F.when(c, F.struct(start.alias("_start"), kind.alias("_kind")))
    nothing = F.lit(None).cast("string")
    roles = F.array(role(kind.isNotNull(), start, kind), role(mark & F.col("_open"), F.col("_line"), nothing), role(mark2 & F.col("_open2"), F.col("_line2"), nothing))
    out = seen.select("source_id", *rest, F.inline(F.filter(roles, lambda r: r.isNotNull())))
    closes = F.col("_kind").isNull()
    return out.select("source_id", "_start", "_kind", closes.alias("_closes"), "line_num", "ts_ns",
                      *[F.when(~closes, F.col(c)).alias(c) for c in rest if c not in ("line_num", "ts_ns")])


def group_traces(df: DataFrame, block_lines: int = BLOCK_LINES) -> Traces:
    """Group matched lines into traces.

    A fatal trace runs from its header over lines of the fatal tag and process-name lines to the first
    other line; a stderr trace from an exception line over lines of the stderr tag that no fatal trace took. A trace that
    nothing closes is reported in ``fatal`` but emits no row. All four results come from one scan of the lines and
    one aggregate by trace.
    """
    fatal_line, stderr_line = F.col("_kind") == "fatal", F.col("_kind") == "stderr"
    starts = ~F.col("_closes") & (F.col("line_num") == F.col("_start"))
    ends = F.col("_closes") | (F.col("_kind") == "single")
    body = fatal_line & F.col("thread").isNull() & F.col("app").isNull() & (F.col("tag") == FATAL_TAG)
    own_code = ~F.col("frame").rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in FRAMEWORK) + ")")
    line = lambda c: F.when(c, F.col("line_num"))
    exc = line(F.col("exc").isNotNull() & (body | (~fatal_line & starts)))  # nulls, as are all fields, in a line that closes the trace
    traces = _traced(df, block_lines).groupBy("source_id", "_start").agg(
        F.max("_kind").alias("_kind"), F.max("thread").alias("crash_thread"),
        F.max_by("app", line(fatal_line & ~starts & F.col("app").isNotNull())).alias("app"),
        F.min_by("exc", exc).alias("exception"),
        F.max_by("cause", line(F.col("cause").isNotNull() & (body | (stderr_line & ~starts)))).alias("root"),
        F.min_by("frame", line(stderr_line & ~starts & F.col("cause").isNull() & F.col("frame").isNotNull() & own_code)).alias("frame"),
        F.max_by("tag", line(starts)).alias("tag"), F.max(line(ends)).alias("_close"), F.max(F.when(ends, F.col("ts_ns"))).alias("_close_ts"))
    is_fatal = F.col("_kind") == "fatal"
    exception = F.coalesce("exception", F.lit(""))
    source = F.when(is_fatal, F.col("app")).when(F.col("_kind") == "single", F.col("tag")).otherwise(F.coalesce("frame", F.lit(STDERR_TAG)))
    emissions = traces.filter(F.col("_close").isNotNull() & (~is_fatal | F.col("app").isNotNull())).select(
        "source_id", F.col("_close").alias("line_num"), F.col("_close_ts").alias("ts_ns"), source.alias("source"),
        exception.alias("exception"), F.coalesce("root", exception).alias("root_cause"),
        F.coalesce(F.when(is_fatal, F.col("crash_thread")), F.lit("")).alias("crash_thread"), F.col("_start").alias("start_line"), is_fatal.alias("fatal"))

    differs = F.col("root").isNotNull() & (F.col("root") != exception)
    detail = F.concat(exception, F.when(differs, F.concat(F.lit(" (root: "), F.col("root"), F.lit(")"))).otherwise(F.lit("")),
                      F.lit(" on "), F.col("crash_thread"))
    known = traces.filter(is_fatal & F.col("app").isNotNull() & (F.col("_close").isNotNull() | F.col("exception").isNotNull()))
    fatal = known.groupBy("source_id", "app").agg(F.max_by(detail, "_start").alias("detail"))
    counts = traces.groupBy("source_id").agg(F.count_if(is_fatal).alias("fatal_count"), F.count_if(~is_fatal).alias("nonfatal_count"))
    nonfatal = emissions.filter("NOT fatal").groupBy("source_id", "source", "exception").agg(F.count("*").alias("n"))
    return Traces(emissions, fatal, counts, nonfatal)
