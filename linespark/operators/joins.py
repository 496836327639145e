"""Lookups and context around lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import truncate_text
from .sections import over_ranges


def pid_in_package(lines: DataFrame, pids: DataFrame, package: str) -> DataFrame:
    """Lines whose pid belongs to a package; ``pids`` has (source_id, pid, package)."""
    own = pids.filter(F.col("package") == package).select("source_id", "pid")
    return lines.join(own, ["source_id", "pid"], "left_semi").select(*lines.columns)


def attach_text(df: DataFrame, lines: DataFrame, max_chars: int | None = None, name: str = "text") -> DataFrame:
    """Raw text of each row's line, whole or shortened to ``max_chars``."""
    raw = F.col("raw") if max_chars is None else truncate_text("raw", max_chars)
    return df.join(lines.select("source_id", "line_num", raw.alias(name)), ["source_id", "line_num"], "left")


def with_context(matches: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """Matched lines and their neighbours within ``n`` lines, each once, flagged ``is_match``.

    Only the matches are expanded; the expanded line numbers are merged per line before the
    join, so overlapping neighbourhoods do not repeat lines.
    """
    wanted = (matches.select("source_id", F.explode(F.sequence(
        F.greatest(F.col("line_num") - n, F.lit(0)), F.col("line_num") + n)).alias("line_num"),
        F.col("line_num").alias("_m")).groupBy("source_id", "line_num")
        .agg(F.max(F.col("_m") == F.col("line_num")).alias("is_match")))
    return lines.join(wanted, ["source_id", "line_num"]).select(*lines.columns, "is_match")


def lines_around(lines: DataFrame, center: int, before: int = 25, after: int = 25, source_id: str | None = None,
                 floor: int = 0) -> DataFrame:
    """Lines around one line, at least ``floor`` on each side, flagged ``is_center``."""
    out = lines if source_id is None else lines.filter(F.col("source_id") == source_id)
    lo, hi = center - max(before, floor), center + max(after, floor)
    return out.filter(F.col("line_num").between(lo, hi)).withColumn("is_center", F.col("line_num") == center)


def with_annotations(lines: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row per line and bookmark or reference covering it; a missing end means one line."""
    ends = annotations.withColumn("end_line", F.coalesce("end_line", "start_line"))
    return over_ranges(lines, ends)


def matched_by(lines: DataFrame, matches: dict[str, DataFrame]) -> DataFrame:
    """Add ``matched_by``: sorted ids of the jobs that matched each line."""
    marks = reduce(DataFrame.unionByName, [m.select("source_id", "line_num", F.lit(i).alias("_id"))
                                           for i, m in matches.items()])
    sets = marks.groupBy("source_id", "line_num").agg(F.sort_array(F.collect_set("_id")).alias("matched_by"))
    return lines.join(sets, ["source_id", "line_num"], "left").withColumn(
        "matched_by", F.coalesce("matched_by", F.array().cast("array<string>")))


def device_facts(lines: DataFrame, patterns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """First match of each ``{fact: (pattern, where)}`` per source, in one aggregation."""
    hit = {}
    for name, (pattern, where) in patterns.items():
        got = F.regexp_extract("raw", pattern, 1)
        ok = (got != "") if where is None else ((got != "") & where)
        hit[name] = F.when(ok, F.trim(got))
    found = lines.select("source_id", "line_num", *[c.alias(n) for n, c in hit.items()])
    found = found.filter(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in hit]))
    return found.groupBy("source_id").agg(
        *[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("line_num"))).alias(n) for n in hit])
