"""Raw lines (``source_id, line_num, raw``) to LINE rows. All parsing is one projection: no shuffle, no UDF.

Each line shape is matched once per line; all its groups come out of that one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.extract import all_groups, matched
from ..functions.levels import level_name, level_ord
from ..functions.scalars import NS_PER_SEC, civil_ns
from ..operators.joins import device_facts as first_matches
from ..operators.sections import with_section
from ..schemas import LINE_COLUMNS

# Line shapes.
THREADTIME = (r"(?s)^(\d{2})-(\d{2}) (\d{2}):(\d{2}):(\d{2})\.(\d{3})\s+(\S+)\s+(\d+)(?:\s+(\d+))?\s+"
              r"([VDIWEFSvdiwefs])\s+(.*?):\s*(.*)$")
BRIEF = r"(?s)^([VDIWEFSvdiwefs])/(.+?)\(\s*(\d+)\):\s*(.*)$"
KERNEL = r"(?s)^(?:<(\d+)>)?\[\s*(\d+)\.(\d+)\]\s+(?:\((\S+)\)\s+)?(.*)$"
CAPTURE_HEADER = r"^== dumpstate: (\d{4})-(\d{2})-(\d{2}) (\d{2}):(\d{2}):(\d{2})"
SEPARATOR = "-----"
GRACE_NS = 300 * NS_PER_SEC


def _line(df: DataFrame, source_type: str, **cols: Column) -> DataFrame:
    given = {"source_type": F.lit(source_type), **cols}
    given["level"] = level_name(given["level_ord"])
    return df.withColumns(given).select(*LINE_COLUMNS)


def _staged(df: DataFrame) -> DataFrame:
    """Add the groups of the two log shapes; the second is tried only where the first fails."""
    df = df.withColumn("_t", all_groups("raw", THREADTIME))
    return df.withColumn("_b", F.when(~matched("_t"), all_groups("raw", BRIEF)))


def _threadtime(year: Column) -> dict[str, Column]:
    g = lambda i: F.get(F.col("_t"), F.lit(i))
    third = g(9) != ""
    num = lambda i: g(i).try_cast("int")
    return {
        "ts_ns": civil_ns(year, num(1), num(2), num(3), num(4), num(5), F.rpad(g(6), 9, "0").try_cast("bigint")),
        "level_ord": level_ord(g(10)), "tag": F.trim(g(11)), "message": g(12),
        "pid": F.coalesce(F.when(third, num(8)).otherwise(num(7)), F.lit(0)),
        "tid": F.when(third, num(9)).otherwise(num(8)),
    }


def parse_threadtime(df: DataFrame, capture_year: int) -> DataFrame:
    """Only the lines in threadtime form: ``MM-DD HH:MM:SS.mmm [uid] pid tid L tag: message``."""
    hit = df.withColumn("_t", all_groups("raw", THREADTIME)).filter(matched("_t"))
    return _line(hit, "Logcat", **_threadtime(F.lit(capture_year)))


def _logcat(year: Column) -> dict[str, Column]:
    """Columns of a staged line: threadtime, else brief, else an Info line holding the text."""
    tt = _threadtime(year)
    b = lambda i: F.get(F.col("_b"), F.lit(i))
    none, zero = F.lit(None).cast("bigint"), F.lit(0)
    brief = {"ts_ns": none, "level_ord": level_ord(b(1)), "tag": F.trim(b(2)), "message": b(4), "pid": b(3).try_cast("int"), "tid": zero}
    other = {"ts_ns": none, "level_ord": F.lit(2), "tag": F.lit(""), "message": F.col("raw"), "pid": zero, "tid": zero}
    types = {"level_ord": "tinyint", "pid": "int", "tid": "int", "ts_ns": "bigint"}
    out = {k: F.when(matched("_t"), tt[k]).when(matched("_b"), brief[k]).otherwise(other[k]) for k in tt}
    return {k: c.cast(types[k]) if k in types else c for k, c in out.items()}


def parse_logcat(df: DataFrame, capture_year: int, keep_separators: bool = False, source_type: str = "Logcat") -> DataFrame:
    """Threadtime or brief lines; other text becomes an Info line; ``-----`` separators are left out."""
    if not keep_separators:
        df = df.filter(~F.col("raw").startswith(SEPARATOR))
    return _line(_staged(df), source_type, **_logcat(F.lit(capture_year)))


def parse_kernel(df: DataFrame, boot_ts_ns: int = 0) -> DataFrame:
    """``<n>[sec.frac] (function) message``; other lines are left out. Times count from ``boot_ts_ns``."""
    df = df.withColumn("_k", all_groups("raw", KERNEL)).filter(matched("_k"))
    g = lambda i: F.get(F.col("_k"), F.lit(i))
    prio = g(1).try_cast("bigint").bitwiseAND(F.lit(7))
    # Kernel priorities 0..7 to level ranks.
    rank = F.element_at(F.array(*[F.lit(x) for x in (5, 5, 4, 4, 3, 2, 2, 1)]), (prio + 1).cast("int"))
    ts = F.lit(boot_ts_ns) + g(2).try_cast("bigint") * NS_PER_SEC + F.rpad(g(3), 9, "0").try_cast("bigint")
    return _line(df, "Kernel", ts_ns=ts, level_ord=F.when(g(1) == "", F.lit(2)).otherwise(rank).cast("tinyint"),
                 tag=F.when(g(4) == "", F.lit("kernel")).otherwise(g(4)), message=g(5), pid=F.lit(0), tid=F.lit(0))


def _capture_ts(raw: Column) -> Column:
    g = lambda i: F.regexp_extract(raw, CAPTURE_HEADER, i).try_cast("int")
    return F.when(raw.rlike(CAPTURE_HEADER), civil_ns(g(1), g(2), g(3), g(4), g(5), g(6)))


def capture_times(df: DataFrame) -> DataFrame:
    """Capture time of each source, from its first ``== dumpstate:`` header."""
    heads = df.filter(F.col("raw").startswith("== dumpstate:"))
    ts = _capture_ts(F.col("raw"))
    return heads.groupBy("source_id").agg(F.min_by(ts, F.when(ts.isNotNull(), F.col("line_num"))).alias("capture_ts_ns"))


def parse_bugreport(df: DataFrame, capture_year: int, source_type: str = "Bugreport") -> DataFrame:
    """Section headers and footers, capture header, embedded log lines with the year corrected, plain content."""
    raw = F.col("raw")
    head = raw.startswith("------")
    footer = head & raw.contains("was the duration of")
    inner = F.trim(F.regexp_replace(F.regexp_replace(raw, r"^-+", ""), r"-+$", ""))
    section = F.when(inner.contains(" ("), F.trim(F.regexp_extract(inner, r"^(.*) \(", 1))).otherwise(inner)
    capture, rule = raw.rlike(CAPTURE_HEADER), raw.startswith("====")
    special = head | capture | rule
    log = _logcat(F.lit(capture_year))
    rank = (F.when(rule | footer, F.lit(0)).when(special, F.lit(2)).otherwise(log["level_ord"])).cast("tinyint")
    tag = (F.when(rule, "").when(capture, "dumpstate").when(footer, F.regexp_extract(raw, "'([^']+)'", 1))
           .when(head, section).otherwise(log["tag"]))
    plain = lambda k, v: F.when(special, v).otherwise(log[k])
    out = _line(_staged(df), source_type, ts_ns=plain("ts_ns", F.lit(None).cast("bigint")), level_ord=rank, tag=tag,
                message=plain("message", raw), pid=plain("pid", F.lit(0)), tid=plain("tid", F.lit(0)))
    return correct_year(out, capture_times(df), capture_year)


def correct_year(lines: DataFrame, captures: DataFrame, capture_year: int) -> DataFrame:
    """Move log times to the capture's year, or the year before when they would lie over 5 minutes after it.

    ``captures`` has one row per source, so the join is a broadcast unless there are very many sources.
    """
    year = lambda ns: F.year(F.date_from_unix_date(F.floor(ns / (86_400 * NS_PER_SEC)).cast("int")))
    days = lambda y: F.unix_date(F.make_date(y, F.lit(1), F.lit(1))).cast("bigint")
    shift = lambda y: (days(y) - days(F.lit(capture_year))) * (86_400 * NS_PER_SEC)
    joined = lines.join(captures, "source_id", "left")
    cap = F.col("capture_ts_ns")
    same = F.col("ts_ns") + shift(year(cap))
    moved = F.when(same > cap + GRACE_NS, F.col("ts_ns") + shift(year(cap) - 1)).otherwise(same)
    return joined.withColumn("ts_ns", F.when(cap.isNotNull(), moved).otherwise(F.col("ts_ns"))).select(*lines.columns)


def device_facts(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Build, device and system facts of each capture: first match each.

    Header facts stand before the first section; the kernel version is the first text line of its section;
    the properties are in theirs.
    """
    placed = with_section(lines, sections.filter(F.col("name").isin("SYSTEM PROPERTIES", "KERNEL VERSION")))
    starts = sections.groupBy("source_id").agg(F.min("start_line").alias("_first_section"))
    placed = placed.join(starts, "source_id", "left")
    top = F.col("_first_section").isNull() | (F.col("line_num") < F.col("_first_section"))
    body = ~F.col("raw").startswith("------")
    props = (F.col("section") == "SYSTEM PROPERTIES") & body
    kernel = (F.col("section") == "KERNEL VERSION") & body
    return first_matches(placed, {
        "build": (r"^Build: (.+)$", top),
        "build_type": (r"^Build: .*\(([^()]*)\)[^()]*$", top),
        "fingerprint": (r"^Build fingerprint: '([^']*)", top),
        "os_version": (r"^Build fingerprint: '[^:']*:([^/']*)/", top),
        "bootloader": (r"^Bootloader: (.+)$", top),
        "serial": (r"androidboot\.serialno *=[ \"]*([^ \"]+)", top),
        "uptime": (r"^Uptime: (.+)$", top),
        "kernel_version": (r"^\s*(\S.*)$", kernel),
        "sdk": (r"^\[ro\.build\.version\.sdk\]: \[(.*)\]$", props),
        "model": (r"^\[ro\.product\.model\]: \[(.*)\]$", props),
        "manufacturer": (r"^\[ro\.product\.manufacturer\]: \[(.*)\]$", props),
    })
