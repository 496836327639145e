"""Stability: kills, crash and exception storms, stack traces, descriptor exhaustion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.extract import extract_fields, field
from ..functions.predicates import level_min, message_contains, message_contains_any, tag_prefix
from ..operators.aggregate import at_max, count_map, counter, running_max, summarize, total
from ..operators.charts import Chart
from ..operators.correlate import Source, correlate
from ..operators.insights import Signal
from ..operators.project import emit
from ..operators.stateful import burst_detect
from ..operators.traces import group_traces
from .base import Job, orelse

# Fixed values throughout this module: tags, message texts, field patterns, thresholds and labels of the log formats.
KILL = {
    "process": r"Killing\s+\d+:([^/\s]+)", "kill_pid": (r"Killing\s+(\d+)", "int"),
    "rss": (r"adj=\S+.*?rss=(\d+)kb", "int"), "why": r"#\d+\s+(.+?)(?:\s+adj=|$)",
}


def process_kills(lines: DataFrame) -> dict[str, DataFrame]:
    x = extract_fields(lines, KILL)
    rows = emit(x, process_name=orelse("process", "unknown"), pid=orelse("kill_pid", 0), rss_kb=orelse("rss", 0),
                reason=orelse("why", "unknown"))
    return {"emissions": rows, "kills_by_reason": count_map(rows, "reason"), "summary": summarize(rows, {
        "total_kills": counter(), "total_rss_freed_kb": total("rss_kb"), "largest_killed_rss_kb": running_max("rss_kb", 0),
        "largest_killed_process": orelse(at_max("process_name", "rss_kb", above=0), "")})}


def crash_storms(lines: DataFrame) -> dict[str, DataFrame]:
    x = extract_fields(lines, {"process_name": r"Process:\s*([^,]+),\s*PID:", "crash_pid": (r"PID:\s*(\d+)", "int")})
    rows = emit(x.filter("process_name IS NOT NULL"), process_name=F.col("process_name"), pid=orelse("crash_pid", 0))
    return {"emissions": rows, "bursts": burst_detect(x, "process_name", 10_000, 3),
            "summary": summarize(rows, {"total_crashes": counter()})}


def exception_storms(lines: DataFrame) -> dict[str, DataFrame]:
    service = field(r"No service published for:\s+(\w+)")
    key = F.coalesce(F.concat(F.lit("ServiceNotFound:"), service), field(r"(\w+(?:Exception|Error))"), F.col("tag"))
    x = lines.withColumn("burst_key", key)
    return {"bursts": burst_detect(x, "burst_key", 2000, 20), "summary": summarize(x, {"total_errors_seen": counter()})}


def exception_traces(lines: DataFrame) -> dict[str, DataFrame]:
    t = group_traces(lines)
    return {"emissions": t.emissions, "summary": t.counts, "fatal_crashes": t.fatal, "nonfatal_summary": t.nonfatal}


FD_MESSAGE = ("FD exhaustion ({{fd_spike.fd_count}} FDs in PID {{fd_spike.pid}}) preceded EBADF {{ebadf_error.operation}} "
              "in PID {{ebadf_error.erring_pid}}")


def fd_exhaustion(lines: DataFrame, within_lines: int = 150_000) -> DataFrame:
    """Bad-descriptor errors shortly after the system server's descriptor count went over 900."""
    spike = Source("fd_spike", tag_prefix("Watchdog") & message_contains("FD:"),
                   {"fd_count": field(r"FD:\s*(\d+)", "int"), "pid": field(r"PID:\s*(\d+)", "int")},
                   lambda f: f["fd_count"] > 900)
    error = Source("ebadf_error", message_contains_any("EBADF", "Bad file descriptor") & level_min("W"),
                   {"operation": field(r"(read|write|close|ioctl|poll|select)\s+(?:failed|error)"),
                    "erring_pid": field(r"^\S+\s+(\d+)", "int")})
    return correlate(lines, error, [spike], within_lines=within_lines, emit=FD_MESSAGE, trigger_first=False)


def _burst_signal(name: str, least: int):
    return lambda: [Signal(name, "critical", F.col("count_in_window") >= least,
                           fields=("burst_key", "count_in_window", "window_ms"))]


JOBS = [
    Job("process-kill-storm", lambda: tag_prefix("ActivityManager") & message_contains("Killing"), process_kills, ("SYSTEM LOG",),
        charts=(Chart("kill_timeline", "time_series", y="rss_kb", agg="sum"),
                Chart("top_killed_by_rss", "bar", x="process_name", y="rss_kb", agg="sum")),
        signals=lambda: [
            Signal("large_kill", "warning", F.col("rss_kb") > 100000, fields=("process_name", "pid", "rss_kb", "reason")),
            Signal("kill_storm", "critical", F.col("total_kills") > 50, "aggregate", ("total_kills", "total_rss_freed_kb"))]),
    Job("crash-storm-detector", lambda: level_min("E") & tag_prefix("AndroidRuntime") & message_contains("Process: "),
        crash_storms, ("SYSTEM LOG",),
        signals=_burst_signal("crash_storm", 3), raised_from="bursts"),
    Job("exception-storm-detector", lambda: level_min("E"), exception_storms, ("SYSTEM LOG",),
        signals=_burst_signal("exception_storm", 20), raised_from="bursts"),
    Job("exception-stack-tracker",
        lambda: message_contains_any("FATAL EXCEPTION", "Exception", "Error", "Process:", "at com."),
        exception_traces, ("SYSTEM LOG",), ("logcat", "bugreport", "dumpstate"),
        signals=lambda: [Signal("fatal_exception", "critical", F.col("fatal"),
                                fields=("source", "exception", "root_cause", "crash_thread", "start_line"))]),
]
