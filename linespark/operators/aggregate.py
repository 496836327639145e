"""Grouped aggregates over lines and result rows. All are partial + final: no ordering, no windows on raw lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import as_col, bucket_floor


def count_lines(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def count_by(df: DataFrame, field: str) -> DataFrame:
    """Rows per value, most frequent first, then by value; missing values are skipped."""
    return (df.filter(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias(field))
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), field))


def count_by_time(df: DataFrame, interval: str | int, ts: str = "ts_ns") -> DataFrame:
    return (df.filter(F.col(ts).isNotNull()).groupBy(bucket_floor(ts, interval).alias("bucket"))
            .agg(F.count("*").alias("n")))


def count_by_time_grouped(df: DataFrame, interval: str | int, by: str, ts: str = "ts_ns") -> DataFrame:
    return (df.filter(F.col(ts).isNotNull() & F.col(by).isNotNull())
            .groupBy(F.col(by).cast("string").alias(by), bucket_floor(ts, interval).alias("bucket"))
            .agg(F.count("*").alias("n")))


def stats_field(df: DataFrame, field: str) -> DataFrame:
    """Minimum, maximum, mean and count of a numeric field; numeric text counts, junk does not."""
    v = F.col(field).try_cast("double")
    return df.select(v.alias("v")).filter("v IS NOT NULL").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.count("v").alias("n")
    ).filter("n > 0")


AGGREGATES = {"count", "count_by", "sum", "min", "max", "avg", "percentile"}


def aggregate(df: DataFrame, specs: list[tuple], by: list[str] | str = (), interval: str | None = None,
              ts: str = "ts_ns") -> DataFrame:
    """Several aggregates at once: ``("count",)``, ``("avg", field)``, ``("percentile", field, 0.95)``…

    Grouped by columns and, with ``interval``, by time bucket. ``percentile`` is exact: see ``exact_percentiles``.
    """
    by = [by] if isinstance(by, str) else list(by)
    keys = [F.col(b) for b in by]
    if interval is not None:
        keys.append(bucket_floor(ts, interval).alias("bucket"))
        df = df.filter(F.col(ts).isNotNull())
    out, exact = [], {}
    for kind, *args in specs:
        if kind not in AGGREGATES:
            raise ValueError(f"unknown aggregate: {kind}")
        if kind == "count":
            out.append(F.count("*").alias("count"))
            continue
        f = args[0]
        x = F.col(f).try_cast("double")
        if kind == "count_by":
            out.append(F.count(f).alias(f"count_{f}"))
        elif kind == "percentile":
            p = float(args[1]) if len(args) > 1 else 0.5
            exact[f"p{round(p * 100):d}_{f}"] = (x, p)
        elif kind == "percentile_approx":  # a bounded sketch, for groups with very many distinct values
            p = args[1] if len(args) > 1 else 0.5
            acc = args[2] if len(args) > 2 else 10_000
            out.append(F.percentile_approx(x, p, acc).alias(f"p{round(p * 100):d}_{f}"))
        else:
            fn = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[kind]
            out.append(fn(x).alias(f"{kind}_{f}"))
    if not exact:
        return df.groupBy(*keys).agg(*out)
    rest = df.groupBy(*keys).agg(*out) if out else df.select(*keys).distinct() if keys else df.groupBy().agg(F.count("*").alias("_n")).drop("_n")
    found = exact_percentiles(df, keys, exact)
    names = [c for c in found.columns if c not in exact]
    same = reduce(lambda a, b: a & b, [rest[n].eqNullSafe(found[n]) for n in names], F.lit(True))
    return rest.join(found, same, "left").select(*[rest[c] for c in rest.columns], *exact)


def exact_percentiles(df: DataFrame, keys: list[Column], wanted: dict[str, tuple[Column, float]], accuracy: int = 10_000) -> DataFrame:
    """``{name: (number, p)}``: for each group the smallest value that a share ``p`` of its values does not exceed, as ``percentile_disc`` gives.

    Selection by narrowing: a bounded sketch gives two values around the percentile, one pass counts what lies below and between
    them, and only the distinct values between them (about ``4 / accuracy`` of the group) are put in order, with their counts. Nothing
    rests on the sketch: where the counts show that the percentile is not between the two, the group's own limits take their place.
    All passes combine before the shuffle, and no task holds a group's values. Groups without a number are left out.
    """
    specs = F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(float(p)).alias("_p"), x.alias("_x")) for n, (x, p) in wanted.items()])
    values = df.select(*keys, F.inline(specs)).filter(F.col("_x").isNotNull())
    by = [c for c in values.columns if c not in ("_p", "_x")]
    on = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in by])
    beside = lambda a, b: a.join(b, on(a, b)).select(*[a[c] for c in a.columns], *[b[c] for c in b.columns if c not in by])

    slack = 2.0 / accuracy
    near = reduce(lambda a, b: a.unionByName(b), [values.filter(F.col("_name") == n).groupBy(*by).agg(
        F.count("*").alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.lit(float(p)).alias("_p"),
        F.percentile_approx("_x", [max(0.0, p - slack), min(1.0, p + slack)], accuracy).alias("_q")) for n, (_, p) in wanted.items()])
    place = F.greatest(F.ceil(F.col("_p") * F.col("_n")), F.lit(1)).alias("_place")
    limits = near.select(*by, place, "_min", "_max", F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
    counted = beside(values.drop("_p"), limits.select(*by, "_lo", "_hi")).groupBy(*by).agg(
        F.count_if(F.col("_x") < F.col("_lo")).alias("_below"), F.count_if(F.col("_x").between(F.col("_lo"), F.col("_hi"))).alias("_inside"))
    known = beside(limits, counted)
    inside = (F.col("_place") > F.col("_below")) & (F.col("_place") <= F.col("_below") + F.col("_inside"))
    picked = known.select(*by, "_place", F.when(inside, F.col("_lo")).otherwise(F.col("_min")).alias("_lo"), F.when(inside, F.col("_hi")).otherwise(F.col("_max")).alias("_hi"),
                          F.when(inside, F.col("_below")).otherwise(F.lit(0)).alias("_below"))
    left = beside(values.drop("_p"), picked).filter(F.col("_x").between(F.col("_lo"), F.col("_hi")))
    distinct = left.groupBy(*by, "_place", "_below", "_x").agg(F.count("*").alias("_c"))
    # A running sum streams through sorted rows, which can spill.
    reached = F.col("_below") + F.sum("_c").over(W.partitionBy(*by).orderBy("_x").rowsBetween(W.unboundedPreceding, 0))
    found = distinct.withColumn("_reached", reached).filter(F.col("_reached") >= F.col("_place"))
    groups = [c for c in by if c != "_name"]
    return found.groupBy(*groups).agg(*[F.min(F.when(F.col("_name") == n, F.col("_x"))).alias(n) for n in wanted])


def level_distribution(lines: DataFrame) -> DataFrame:
    return lines.groupBy("level").agg(F.count("*").alias("n"))


def top_tags(lines: DataFrame, n: int = 50) -> DataFrame:
    return (lines.filter(F.col("tag") != "").groupBy("tag").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "tag").limit(n))


def source_metadata(lines: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Lines, bytes (with line ends), first time in line order, latest time and section count per source."""
    out = lines.groupBy("source_id").agg(
        F.count("*").alias("total_lines"), F.sum(F.octet_length("raw") + 1).alias("bytes"),
        F.min_by("ts_ns", F.when(F.col("ts_ns").isNotNull(), F.col("line_num"))).alias("first_ts_ns"),
        F.max("ts_ns").alias("last_ts_ns"))
    if sections is None:
        return out.withColumn("sections", F.lit(0).cast("bigint"))
    counts = sections.groupBy("source_id").agg(F.count("*").alias("sections"))
    return out.join(counts, "source_id", "left").withColumn("sections", F.coalesce("sections", F.lit(0)))


def search_summary(matches: DataFrame) -> DataFrame:
    """Total, per-level and per-tag counts in one pass: ``kind`` is total, level or tag.

    Rows are counted per (level, tag) first; only those counts are expanded into the three groupings.
    """
    pairs = matches.groupBy("level", F.nullif("tag", F.lit("")).alias("tag")).agg(F.count("*").alias("_n"))
    sets = pairs.groupingSets([[], ["level"], ["tag"]], "level", "tag").agg(F.sum("_n").alias("n"), F.grouping_id().alias("gid"))
    kind = F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "level").otherwise("tag")
    key = F.when(F.col("gid") == 3, "").when(F.col("gid") == 1, F.col("level")).otherwise(F.col("tag"))
    return sets.select(kind.alias("kind"), key.alias("key"), "n").filter("key IS NOT NULL")


sample_stats = search_summary


# -- accumulators ----------------------------------------------------------------------------

def counter(when: Column | None = None) -> Column:
    return F.count("*") if when is None else F.count_if(when)


def total(x: Column | str) -> Column:
    return F.coalesce(F.sum(as_col(x)), F.lit(0))


def running_min(x: Column | str, default) -> Column:
    return F.least(F.coalesce(F.min(as_col(x)), F.lit(default)), F.lit(default))


def running_max(x: Column | str, default) -> Column:
    return F.greatest(F.coalesce(F.max(as_col(x)), F.lit(default)), F.lit(default))


def last_value(x: Column | str, order: str = "line_num") -> Column:
    """Value at the latest row in which it is present."""
    c = as_col(x)
    return F.max_by(c, F.when(c.isNotNull(), F.col(order)))


def first_value(x: Column | str, order: str = "line_num") -> Column:
    c = as_col(x)
    return F.min_by(c, F.when(c.isNotNull(), F.col(order)))


def at_max(value: Column | str, x: Column | str, order: str = "line_num", above=None) -> Column:
    """``value`` where ``x`` is largest; the earliest row wins a tie. ``above`` asks for more than a floor."""
    x = as_col(x)
    key = F.struct(x.alias("x"), (-F.col(order)).alias("o"))
    ok = x.isNotNull() if above is None else (x > F.lit(above))
    return F.max_by(as_col(value), F.when(ok, key))


def average(part: Column, whole: Column) -> Column:
    """Integer average of two aggregates; 0 on an empty base."""
    p, w = part.cast("bigint"), whole.cast("bigint")
    return F.when(w > 0, ((p - p % w) / w).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def summarize(df: DataFrame, specs: dict[str, Column], keys=("source_id",)) -> DataFrame:
    """Named accumulators in one aggregation per key."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in specs.items()])


def count_map(df: DataFrame, field: Column | str, keys=("source_id",), name: str = "key") -> DataFrame:
    """Rows per value, as a long table - the scalable form of a map of counters."""
    return (df.withColumn(name, as_col(field).cast("string")).filter(F.col(name).isNotNull())
            .groupBy(*keys, name).agg(F.count("*").alias("n")))


def max_map(df: DataFrame, field: Column | str, x: Column | str, keys=("source_id",), name: str = "key") -> DataFrame:
    """Largest ``x`` per value."""
    return (df.withColumns({name: as_col(field).cast("string"), "_x": as_col(x)}).filter(F.col(name).isNotNull())
            .groupBy(*keys, name).agg(F.max("_x").alias("max")))


def top_map_entries(df: DataFrame, key: str = "key", val: str = "n", n: int = 20, keys=("source_id",)) -> DataFrame:
    """The ``n`` largest entries of each map, with ``total_keys`` and ``truncated``."""
    order = W.partitionBy(*keys).orderBy(F.desc(val), key)
    totals = df.groupBy(*keys).agg(F.count("*").alias("total_keys"))
    top = df.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)
    return top.join(totals, list(keys)).withColumn("truncated", F.col("total_keys") > n)


def rank_map(df: DataFrame, key: str = "key", val: str = "n") -> DataFrame:
    return df.orderBy(F.desc(val), key)


def merge_results(a: dict[str, DataFrame], b: dict[str, DataFrame], var: str = "var", batch: str = "batch") -> dict:
    """Join two batches' results: emissions appended, variables latest-wins, errors summed."""
    out = {}
    for name in {**a, **b}:
        parts = [d[name] for d in (a, b) if name in d]
        both = reduce(DataFrame.unionByName, parts)
        if name == "vars":
            keys = [c for c in ("source_id", var) if c in both.columns]
            rest = [c for c in both.columns if c not in keys]
            both = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), batch).alias("_r")).select(*keys, "_r.*")
        elif name == "errors":
            keys = [c for c in both.columns if c not in ("errors", "first_line")]
            both = both.groupBy(*keys).agg(F.sum("errors").alias("errors"), F.min("first_line").alias("first_line"))
        out[name] = both
    return out


def run_summary(results: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Rows per job: ``{job: (kind, result)}`` -> ``job``, ``kind``, ``n``."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(j).alias("job"), F.lit(kind).alias("kind"), "n")
             for j, (kind, df) in results.items()]
    return reduce(DataFrame.unionByName, parts)
