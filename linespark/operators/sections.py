"""Sections: building them, attaching them to lines, gating by them.

Lines are never shuffled as a whole for a section lookup. Ranges that do not overlap are cut
into fixed-size line blocks, which turns the range join into an equi-join on
``(source_id, block)``; no block is in more of them than it has lines. Ranges that may nest are cut
into dyadic nodes, at most two of each length ``2^level`` blocks, and a block of lines asks for the
node it lies in on every level that some range uses: a range over a whole source is a few rows,
not one for each block. Spark broadcasts the ranges when they are small by its own size
check and otherwise joins node by node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordered import BLOCK_LINES, rank_lines, scan, settle

RANGE_BLOCK = 1 << 14


def in_blocks(ranges: DataFrame, start: str, end: str, block: int = RANGE_BLOCK) -> DataFrame:
    """One row per line block a range touches, as ``_b``."""
    return ranges.filter(F.col(start) <= F.col(end)).withColumn(
        "_b", F.explode(F.sequence(F.expr(f"{start} div {block}L"), F.expr(f"{end} div {block}L"))))


def dyadic(ranges: DataFrame, start: str, end: str, block: int = RANGE_BLOCK) -> DataFrame:
    """One row per dyadic node of a range, as ``_lvl`` and ``_node``: the fewest aligned runs of ``2^_lvl`` blocks that make up the blocks it touches."""
    shift = lambda c, by: F.call_function("shiftright", c, by)
    lo, stop = F.expr(f"`{start}` div {int(block)}L"), F.expr(f"`{end}` div {int(block)}L + 1")

    def nodes(level: Column) -> Column:
        # Of the nodes of a level inside the range, those whose parent is not: an odd first one, an even last one.
        unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        first, past = shift(lo + unit - 1, level), shift(stop, level)
        node = lambda n: F.struct(level.alias("_lvl"), n.alias("_node"))
        return F.array(F.when((first < past) & (first % 2 == 1), node(first)), F.when((first < past) & (past % 2 == 1), node(past - 1)))
    levels = F.sequence(F.lit(0), F.floor(F.log2(stop - lo)).cast("int") + 1)
    found = F.filter(F.flatten(F.transform(levels, nodes)), lambda n: n.isNotNull())
    return ranges.filter(F.col(start) <= F.col(end)).select("*", F.inline(found))


def over_ranges(points: DataFrame, ranges: DataFrame, start: str = "start_line", end: str = "end_line", position: str = "line_num",
                block: int = RANGE_BLOCK) -> DataFrame:
    """One row per point and range of its source that holds it, with the columns of both.

    The blocks that hold points ask the nodes, so a block and not each of its points is repeated for every level; the points then meet
    the ranges of their block.
    """
    cut = dyadic(ranges, start, end, block)
    at = points.withColumn("_b", F.expr(f"`{position}` div {int(block)}L"))
    asked = _asked(at.select("source_id", "_b").distinct(), cut)
    held = asked.join(cut, ["source_id", "_lvl", "_node"]).drop("_lvl", "_node")
    return at.join(held, ["source_id", "_b"]).filter(F.col(position).between(F.col(start), F.col(end))).drop("_b")


def _asked(blocks: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows with ``_b`` once for every level in use, with the node (``_lvl``, ``_node``) that holds them there.

    The levels, at most 63 rows, are joined and not exploded from an array: Spark takes an explode to give as many bytes as it
    reads, and would broadcast the repeated rows of a small file.
    """
    levels = F.broadcast(cut.select("_lvl").distinct())
    return blocks.crossJoin(levels).withColumn("_node", F.call_function("shiftright", F.col("_b"), F.col("_lvl")))


def summarize_ranges(points: DataFrame, ranges: DataFrame, sums: dict[str, Column] | None = None, peaks: dict[str, Column] | None = None,
                     start: str = "start_line", end: str = "end_line", position: str = "line_num", block: int = RANGE_BLOCK) -> DataFrame:
    """``source_id``, start and end of every different range that holds a point, with sums and largest values over the points it holds.

    What grouping ``over_ranges`` gives, without a row for each point and range: points are summed up per block and block sums per
    dyadic node; a range adds up the nodes of the blocks it holds whole and meets only the points of its first and last block.
    """
    sums, peaks = sums or {}, peaks or {}
    name = {**{n: F.sum for n in sums}, **{n: F.max for n in peaks}}
    again = [f(n).alias(n) for n, f in name.items()]
    size, keys = int(block), ["source_id", "_from", "_to"]
    at = points.select("source_id", F.col(position).alias("_at"), F.expr(f"`{position}` div {size}L").alias("_b"),
                       *[c.alias(n) for n, c in {**sums, **peaks}.items()])
    asked = ranges.select("source_id", F.col(start).alias("_from"), F.col(end).alias("_to")).distinct().filter("_from <= _to")
    first, last = F.expr(f"_from div {size}L"), F.expr(f"_to div {size}L")

    whole = asked.withColumns({"_lo": (first + 1) * size, "_hi": last * size - 1})
    cut = dyadic(whole, "_lo", "_hi", block).drop("_lo", "_hi")
    blocks = at.groupBy("source_id", "_b").agg(*again)
    nodes = _asked(blocks, cut).groupBy("source_id", "_lvl", "_node").agg(*again)
    inner = cut.join(nodes, ["source_id", "_lvl", "_node"]).select(*keys, *name)
    edges = asked.withColumn("_b", F.explode(F.array_distinct(F.array(first, last))))
    outer = edges.join(at, ["source_id", "_b"]).filter("_at BETWEEN _from AND _to").select(*keys, *name)
    return inner.unionByName(outer).groupBy(*keys).agg(*again).withColumnsRenamed({"_from": start, "_to": end})


def matched_pairs(marks: DataFrame, keys: list[str], opens: Column, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Pairs of opening and closing marks of each key: a closer takes the latest opener that is still open, and does nothing when there is none.

    Parallel bracket matching by block scans: the sum of steps (+1, -1) and its lowest value so far give the number of open marks, never
    below zero; a closer's opener is the mark just before it on the same depth. Sums, minima and latest marks compose, so
    no task holds a key's marks. Gives the keys, ``start_line`` and ``end_line``.
    """
    step = F.when(opens, F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    run = scan(marks.select(*keys, "line_num", opens.alias("_opens"), step.alias("_step")), keys=keys, before={"_run": F.col("_step")}, block_lines=block_lines)
    low = scan(run.withColumn("_up_to", F.col("_run") + F.col("_step")), keys=keys, peak={"_dip": -F.col("_up_to")}, block_lines=block_lines)
    lowest = F.least(-F.coalesce("_dip", F.lit(0)), F.lit(0))  # of the marks before
    depth = F.when(F.col("_opens"), F.col("_up_to") - F.least(lowest, F.col("_up_to"))).otherwise(F.col("_run") - lowest)
    levels = low.withColumn("_depth", depth).filter("_depth > 0")
    seen = scan(levels.select(*keys, "_depth", "line_num", "_opens"), keys=(*keys, "_depth"), prev={"_before": F.struct("_opens", "line_num")}, block_lines=block_lines)
    return seen.filter("NOT _opens AND _before._opens").select(*keys, F.col("_before.line_num").alias("start_line"), F.col("line_num").alias("end_line"))


def line_block(df: DataFrame, block: int = RANGE_BLOCK) -> DataFrame:
    return df.withColumn("_b", F.expr(f"line_num div {block}L"))


def build_sections(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Section table from parsed capture lines (``raw`` text; see ``parse_bugreport``).

    A ``------ NAME (source) ------`` header is paired with the duration footer naming it; with
    repeated headers of one name a footer closes the nearest open one. Headers without a
    footer give no section. Service dumps inside ``DUMPSYS*`` sections become children that
    end before the next child or with their parent. Runs three small jobs and keeps their tables in the checkpoint folder.
    """
    raw = F.col("raw")
    marks = lines.filter(raw.startswith("------") | raw.startswith("DUMP OF SERVICE "))
    is_footer = raw.startswith("------") & raw.contains("was the duration of")
    inner = F.trim(F.regexp_replace(F.regexp_replace(raw, r"^-+", ""), r"-+$", ""))
    head_name = F.when(inner.contains(" ("), F.trim(F.regexp_extract(inner, r"^(.*) \(", 1))).otherwise(inner)
    service = F.trim(F.regexp_replace(F.substr(raw, F.lit(len("DUMP OF SERVICE ") + 1)), r":+$", ""))
    service = F.regexp_replace(service, r"^(?:CRITICAL|HIGH) ", "")
    kind = F.when(raw.startswith("DUMP OF"), "D").when(is_footer, "F").otherwise("H")
    name = F.when(raw.startswith("DUMP OF"), service).when(is_footer, F.regexp_extract(raw, r"'([^']+)'", 1)).otherwise(head_name)
    # Generated columns are computed once; plain aliases would be repeated in every later filter.
    marks = marks.select("source_id", "line_num", F.inline(F.array(F.struct(kind.alias("kind"), name.alias("name")))))
    marks = marks.filter((F.col("name") != "") & (F.col("name") != "dumpstate"))

    # Marks and sections are few beside the lines; stored, the lines are read once and each scan starts from a table.
    marks = settle(marks)
    tops = settle(matched_pairs(marks.filter("kind != 'D'"), ["source_id", "name"], F.col("kind") == "H", block_lines))

    dumps = marks.filter("kind = 'D'").select("source_id", F.col("name").alias("child"), F.col("line_num").alias("at"))
    parents = tops.filter(F.col("name").startswith("DUMPSYS"))
    kids = over_ranges(dumps, parents.drop("name"), position="at").filter(F.col("at") > F.col("start_line"))
    kids = settle(scan(kids, keys=("source_id", "start_line", "end_line"), order=("at",), next={"_next": F.col("at")}, block_lines=block_lines).select(
        "source_id", F.col("child").alias("name"), F.col("at").alias("start_line"),
        F.coalesce(F.col("_next") - 1, F.col("end_line")).alias("end_line"), F.col("start_line").alias("_parent")))
    both = tops.withColumn("_parent", F.lit(None).cast("bigint")).unionByName(kids).withColumn("_end", -F.col("end_line"))
    numbered = rank_lines(both, "section_idx", order=("start_line", "_end")).withColumn("section_idx", F.col("section_idx").cast("int"))
    # Top-level starts are unique per source, so the parent index is a lookup on the start line.
    idx = numbered.filter("_parent IS NULL").select("source_id", F.col("start_line").alias("_parent"),
                                                     F.col("section_idx").alias("parent_index"))
    return numbered.join(idx, ["source_id", "_parent"], "left").select(
        "source_id", "section_idx", "name", "start_line", "end_line", "parent_index")


def innermost_ranges(sections: DataFrame) -> DataFrame:
    """Disjoint ranges in which each section is the last one started and not yet over."""
    ahead = scan(sections, order=("start_line", "section_idx"), next={"_next": F.col("start_line")})
    return ahead.withColumn("_stop", F.least("end_line", F.coalesce(F.col("_next") - 1, F.col("end_line")))).select(
        "source_id", F.col("start_line").alias("_start"), "_stop", F.col("name").alias("section"),
        F.col("section_idx")).filter("_start <= _stop")


def with_section(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Add ``section``: the last section started at or before the line, NULL if that one has ended."""
    ranges = in_blocks(innermost_ranges(sections).drop("section_idx"), "_start", "_stop")
    hit = F.col("line_num").between(F.col("_start"), F.col("_stop"))
    l, r = line_block(lines).alias("l"), ranges.alias("r")
    cond = (F.col("l.source_id") == F.col("r.source_id")) & (F.col("l._b") == F.col("r._b")) & hit
    return l.join(r, cond, "left").select(*[F.col(f"l.{c}") for c in lines.columns], F.col("r.section").alias("section"))


def containing_sections(lines: DataFrame, sections: DataFrame, block: int = RANGE_BLOCK) -> DataFrame:
    """One row per line and section whose range holds it, with ``depth`` 0 for the outermost."""
    out = over_ranges(lines, sections.select("source_id", "section_idx", "name", "start_line", "end_line"), block=block)
    w = W.partitionBy("source_id", "line_num").orderBy("start_line", F.desc("end_line"), "section_idx")
    return out.withColumn("depth", F.row_number().over(w) - 1)


def _runs(rows: DataFrame, order) -> DataFrame:
    """Add ``_run``, the number of rows up to here that start a run (``_new`` is 1)."""
    return scan(rows, order=order, before={"_run": F.col("_new")}).withColumn("_run", F.col("_run") + F.col("_new"))


def merged_ranges(ranges: DataFrame, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Union of overlapping or touching ranges per source, as ``_start``/``_stop``."""
    reached = scan(ranges.select("source_id", start, end), order=(start, end), peak={"_reach": F.col(end)})
    new = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + 1), 1).otherwise(0)
    runs = _runs(reached.withColumn("_new", new), (start, end, "_new"))
    return runs.groupBy("source_id", "_run").agg(F.min(start).alias("_start"), F.max(end).alias("_stop")).drop("_run")


def in_sections(lines: DataFrame, sections: DataFrame, names: list[str], on_missing: str = "all") -> DataFrame:
    """Lines inside any range of the named sections.

    A source in which no name resolves keeps all its lines (``on_missing="all"``) or none.
    """
    if on_missing not in ("all", "none"):
        raise ValueError("on_missing must be 'all' or 'none'")
    wanted = merged_ranges(sections.filter(F.col("name").isin(list(names))))
    ranges = in_blocks(wanted, "_start", "_stop")
    l, r = line_block(lines).alias("l"), ranges.alias("r")
    cond = ((F.col("l.source_id") == F.col("r.source_id")) & (F.col("l._b") == F.col("r._b"))
            & F.col("line_num").between(F.col("_start"), F.col("_stop")))
    if on_missing == "none":
        return l.join(r, cond, "left_semi").select(*lines.columns)
    known = wanted.select(F.col("source_id").alias("_known")).distinct()
    out = l.join(r, cond, "left").join(known, F.col("l.source_id") == F.col("_known"), "left")
    return out.filter(F.col("r._start").isNotNull() | F.col("_known").isNull()).select(
        *[F.col(f"l.{c}") for c in lines.columns])


def filter_sections(sections: DataFrame, query: str) -> DataFrame:
    """Sections whose name holds ``query`` ignoring case, plus parents of hits and all children of hit parents."""
    if not query:
        return sections
    hit = F.lower("name").contains(query.lower())
    hits = sections.filter(hit)
    keep = (hits.select("source_id", "section_idx")
            .unionByName(hits.filter("parent_index IS NOT NULL").select("source_id", F.col("parent_index").alias("section_idx")))
            .unionByName(sections.alias("c").join(
                hits.filter("parent_index IS NULL").select("source_id", F.col("section_idx").alias("parent_index")),
                ["source_id", "parent_index"])
                .select("source_id", "section_idx"))).distinct()
    return sections.join(keep, ["source_id", "section_idx"], "left_semi")


def section_groups(sections: DataFrame, min_run: int = 5) -> DataFrame:
    """Runs of at least ``min_run`` consecutive childless top-level sections sharing an upper-case prefix.

    The prefix is the leading upper-case words followed by a space (``SHOW MAP 1690: x`` -> ``SHOW MAP ``).
    """
    parents = sections.filter("parent_index IS NOT NULL").select(
        "source_id", F.col("parent_index").alias("section_idx")).distinct()
    top = sections.filter("parent_index IS NULL").join(parents, ["source_id", "section_idx"], "left_anti")
    top = top.withColumn("prefix", F.regexp_extract("name", r"^([A-Z][A-Z0-9_]+(?: [A-Z][A-Z0-9_]+)* )", 1))
    in_order = ("start_line", "section_idx")
    top = scan(top, order=in_order, prev={"_before": F.struct("prefix")})
    change = F.when(F.col("_before").isNotNull() & F.col("prefix").eqNullSafe(F.col("_before.prefix")), 0).otherwise(1)
    runs = _runs(top.withColumn("_new", change), in_order).filter("prefix != ''")
    return runs.groupBy("source_id", "_run", "prefix").agg(
        F.count("*").alias("sections"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"),
        F.sum(F.col("end_line") - F.col("start_line") + 1).alias("total_lines")).filter(
        F.col("sections") >= min_run).drop("_run")
