"""Several sources as one timeline, and unions of matched lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.levels import level_rank
from ..functions.predicates import ts_between
from .joins import attach_text
from .ordered import global_rank

ORDER = ["ts_ns", "source_id", "line_num"]


def merge_sources(*dfs: DataFrame) -> DataFrame:
    """All timed lines of several sources, unordered."""
    return reduce(DataFrame.unionByName, dfs).filter("ts_ns IS NOT NULL")


def timeline(*dfs: DataFrame) -> DataFrame:
    """All timed lines ordered by (time, source, line): a range-partitioned sort, no single task."""
    return merge_sources(*dfs).orderBy(*ORDER)


def timeline_range(tl: DataFrame, start: int, end: int) -> DataFrame:
    """Lines within [start, end]; an inverted range is empty."""
    return tl.filter(ts_between(start, end))


def timeline_index(tl: DataFrame) -> DataFrame:
    """0-based ``position`` of every line in the timeline, as (ts_ns, source_id, line_num, position).

    Only the three order columns are sorted and checkpointed; join the texts back where they are needed.
    """
    return global_rank(tl.select(*ORDER), ORDER, "position")


def cross_query(tl: DataFrame, start: int | None = None, end: int | None = None, tags: list[str] | None = None,
                sources: list[str] | None = None, min_level: str | None = None, max_results: int | None = None) -> DataFrame:
    """Lines of the timeline that pass time, exact tag, source and level tests, in its order; only the first ``max_results`` when that is given."""
    out = tl.filter(ts_between(start, end))
    if tags:
        out = out.filter(F.col("tag").isin(list(tags)))
    if sources:
        out = out.filter(F.col("source_id").isin(list(sources)))
    if min_level:
        out = out.filter(F.col("level_ord") >= level_rank(min_level))
    out = out.orderBy(*ORDER)
    return out if max_results is None else out.limit(max_results)


def union_matches(*dfs: DataFrame) -> DataFrame:
    """Distinct (source, line) pairs of several results."""
    return reduce(DataFrame.unionByName, [d.select("source_id", "line_num") for d in dfs]).distinct()


def matched_lines(result: DataFrame, lines: DataFrame | None = None, max_chars: int | None = None) -> DataFrame:
    """Lines behind a job result of any kind, with their text (whole, or shortened to ``max_chars``) when ``lines`` is given."""
    column = "line_num" if "line_num" in result.columns else "trigger_line"
    out = result.select("source_id", F.col(column).alias("line_num")).distinct()
    return out if lines is None else attach_text(out, lines, max_chars)
