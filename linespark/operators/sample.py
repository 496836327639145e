"""Search, paging and sampling. Limits here are the feature itself (a page, a top-n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.extract import group_count
from ..functions.predicates import search_condition
from .joins import with_context
from .ordered import BLOCK_LINES, rank_lines


def search(lines: DataFrame, text: str | None = None, is_regex: bool = False, case_sensitive: bool = False,
           min_level: str | None = None, tags: list[str] | None = None, start_time: str | None = None,
           end_time: str | None = None) -> DataFrame:
    return lines.filter(search_condition(text, is_regex, case_sensitive, min_level, tags, start_time, end_time))


def search_captures(lines: DataFrame, regex: str, limit: int | None = None, column: str = "raw") -> DataFrame:
    """Matching lines with their capture groups as an array (group 0 when the pattern has none)."""
    n = group_count(regex)
    groups = [F.regexp_extract(column, regex, i) for i in (range(1, n + 1) if n else [0])]
    out = lines.filter(F.col(column).rlike(regex)).withColumn("captures", F.array(*groups))
    return out if limit is None else out.orderBy("source_id", "line_num").limit(limit)


def page(df: DataFrame, offset: int, count: int, block_lines: int = BLOCK_LINES, order: str = "line_num") -> DataFrame:
    """Rows ``[offset, offset + count)`` of each source in line order.

    Row counts per line block tell which blocks hold the page; only those blocks' rows are
    shuffled and numbered, so deep pages cost no more than the first.
    """
    blocked = df.withColumn("_block", F.expr(f"{order} div {int(block_lines)}L"))
    counts = blocked.groupBy("source_id", "_block").agg(F.count("*").alias("_n"))
    w = W.partitionBy("source_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    wanted = counts.withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0))).filter(
        (F.col("_base") < offset + count) & (F.col("_base") + F.col("_n") > offset)).drop("_n")
    near = blocked.join(wanted, ["source_id", "_block"])
    inside = W.partitionBy("source_id", "_block").orderBy(order)
    pos = F.col("_base") + F.row_number().over(inside) - 1
    return near.withColumn("position", pos).filter(
        (F.col("position") >= offset) & (F.col("position") < offset + count)).select(*df.columns, "position")


def sample_uniform(lines: DataFrame, n: int, contiguous: bool = True, where: Column | None = None) -> DataFrame:
    """``n`` evenly spaced lines per source: positions ``i * total div n``; with a filter, evenly spaced among all its matches.

    With contiguous line numbers the position is the line number and no row is shuffled for
    ranking; otherwise set ``contiguous=False``. Matches of a filter are always ranked.
    """
    if where is not None:
        lines, contiguous = lines.filter(where), False
    base = lines.withColumn("_pos", F.col("line_num")) if contiguous else rank_lines(lines, "_pos")
    totals = lines.groupBy("source_id").agg(F.count("*").alias("_total"))
    take = F.least(F.lit(n).cast("bigint"), F.col("_total"))
    picks = totals.withColumn("_take", take).select(
        "source_id", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_take") - 1),
                                           lambda i: F.floor(i * F.col("_total") / F.col("_take")))).alias("_pos"))
    return base.join(picks, ["source_id", "_pos"]).select(*lines.columns)


def sample_recent(lines: DataFrame, n: int, where: Column | None = None) -> DataFrame:
    """Newest ``n`` lines per source; with a filter, its newest ``n`` matches, however old they are."""
    return latest(lines if where is None else lines.filter(where), n)


def sample_around(lines: DataFrame, center: int, n: int, where: Column | None = None) -> DataFrame:
    """``n`` lines centred on a line; with a filter, the ``n`` matches nearest to it (earlier first on a tie).

    Lines are counted, not line numbers, so gaps in the numbers do not shorten the sample. In the filtered form each block first keeps
    its own nearest ``n``, so a hot source is cut down before it is ranked.
    """
    if where is None:
        first = lines.groupBy("source_id").agg(F.count(F.when(F.col("line_num") < center, 1)).alias("_at"))
        start = F.greatest(F.col("_at") - n // 2, F.lit(0))
        placed = rank_lines(lines, "_pos").join(first, "source_id")
        return placed.filter((F.col("_pos") >= start) & (F.col("_pos") < start + n)).select(*lines.columns)
    order = [F.abs(F.col("line_num") - center), "line_num"]
    near = lines.filter(where).withColumn("_block", F.expr(f"line_num div {BLOCK_LINES}L"))
    for group in (["source_id", "_block"], ["source_id"]):
        near = near.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("_r") <= n)
    return near.select(*lines.columns)


def digest(lines: DataFrame, k: int = 40) -> DataFrame:
    """First, middle and last ``k`` lines of each source, each once; lines are counted, not line numbers."""
    size = lines.groupBy("source_id").agg(F.count("*").alias("_total"))
    mid = F.expr("_total div 2") - k // 2
    n = F.col("_pos")
    return rank_lines(lines, "_pos").join(size, "source_id").filter(
        (n < k) | ((n >= mid) & (n < mid + k)) | (n >= F.col("_total") - k)).select(*lines.columns)


def search_with_context(lines: DataFrame, regex: str, limit: int = 20, context: int = 3, offset: int = 0,
                        where: Column | None = None) -> DataFrame:
    """A page of regex matches per source with ``context`` lines around each and the full match count."""
    hits = lines.filter(F.col("raw").rlike(regex) if where is None else F.col("raw").rlike(regex) & where)
    paged = page(hits.select("source_id", "line_num"), offset, limit)
    totals = hits.groupBy("source_id").agg(F.count("*").alias("total_matches"))
    return with_context(paged, lines, context).join(totals, "source_id")


def latest(df: DataFrame, n: int, keys=("source_id",)) -> DataFrame:
    """Newest ``n`` result rows per key.

    Each block first keeps its own newest ``n``, so a hot key is cut down before it is ranked.
    """
    cols = df.columns
    near = W.partitionBy(*keys, "_block").orderBy(F.desc("line_num"))
    top = df.withColumn("_block", F.expr(f"line_num div {BLOCK_LINES}L")).withColumn(
        "_r", F.row_number().over(near)).filter(F.col("_r") <= n)
    whole = W.partitionBy(*keys).orderBy(F.desc("line_num"))
    return top.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= n).select(*cols)
