"""Chart series and downsampling as flat tables (chart_id, series, x, y, label)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import bucket_floor
from .ordered import BLOCK_LINES, global_rank, rank_lines

AGGS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def _measure(agg: str, y: str | None) -> Column:
    if agg == "count" or y is None:
        return F.count("*").cast("double")
    return AGGS[agg](F.col(y).try_cast("double"))


def bar_chart(df: DataFrame, x: str, agg: str = "count", y: str | None = None) -> DataFrame:
    """One bar per value, most frequent first; ``x`` is the rank."""
    bars = (df.filter(F.col(x).isNotNull()).groupBy(F.col(x).cast("string").alias("label"))
            .agg(F.count("*").alias("_n"), _measure(agg, y).alias("y")))
    ranked = global_rank(bars, [F.desc("y" if agg != "count" else "_n"), "label"], "x")
    return ranked.select(F.lit("count" if agg == "count" else f"{agg}({y})").alias("series"),
                         F.col("x").cast("double").alias("x"), "y", "label")


pie_chart = bar_chart


def time_series_chart(df: DataFrame, bucket: str = "1m", group_by: str | None = None, agg: str = "count",
                      y: str | None = None, ts: str = "ts_ns") -> DataFrame:
    """Value per time bucket, one series per group."""
    df = df.filter(F.col(ts).isNotNull())
    series = F.lit("count" if agg == "count" else f"{agg}({y})")
    if group_by:
        df = df.filter(F.col(group_by).isNotNull())
        series = F.col(group_by).cast("string")
    out = df.groupBy(series.alias("series"), bucket_floor(ts, bucket).alias("_b")).agg(_measure(agg, y).alias("y"))
    return out.select("series", F.col("_b").cast("double").alias("x"), "y", F.lit(None).cast("string").alias("label"))


area_chart = time_series_chart


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows in which both fields are numeric."""
    out = df.select(F.lit("data").alias("series"), F.col(x).try_cast("double").alias("x"),
                    F.col(y).try_cast("double").alias("y"), F.lit(None).cast("string").alias("label"))
    return out.filter("x IS NOT NULL AND y IS NOT NULL")


def histogram(df: DataFrame, field: str, bins: int = 20, range: tuple[float, float] | None = None) -> DataFrame:
    """Counts per equal-width bin, empty bins included; ``x`` is the bin centre.

    Values outside an explicit range fall into the end bins. No values or zero width give no bins.
    """
    vals = df.select(F.col(field).try_cast("double").alias("v")).filter("v IS NOT NULL")
    if range is not None:
        lo, hi = F.lit(float(range[0])), F.lit(float(range[1]))
    else:
        lo, hi = vals.select(F.min("v")).scalar(), vals.select(F.max("v")).scalar()
    # Without values there are no bins; with a derived range the width is NULL then anyway.
    any_value = vals.select(F.lit(True)).limit(1).scalar() if range is not None else F.lit(True)
    width = (hi - lo) / bins
    idx = F.least(F.greatest(F.floor((F.col("v") - lo) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = vals.filter(width > 0).groupBy(idx.alias("bin")).agg(F.count("*").alias("n"))
    slots = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return slots.join(counts, "bin", "left").filter(any_value & (width > 0)).select(
        F.lit(field).alias("series"), (lo + width * (F.col("bin") + 0.5)).alias("x"),
        F.coalesce("n", F.lit(0)).cast("double").alias("y"), F.lit(None).cast("string").alias("label"))


@dataclass(frozen=True)
class Chart:
    """``kind``: bar, pie, time_series, area, scatter or histogram.

    ``mode="count"`` draws bars and time series as plain counts whatever ``agg`` says.
    """

    id: str
    kind: str
    x: str | None = None
    y: str | None = None
    agg: str = "count"
    bucket: str = "1m"
    group_by: str | None = None
    bins: int = 20
    range: tuple[float, float] | None = None


def build_charts(df: DataFrame, specs: list[Chart], mode: str = "aggregate") -> DataFrame:
    """All charts of a job as one table."""
    out = []
    for c in specs:
        agg = "count" if mode == "count" else c.agg
        if c.kind in ("bar", "pie"):
            part = bar_chart(df, c.x, agg, c.y)
        elif c.kind in ("time_series", "area"):
            part = time_series_chart(df, c.bucket, c.group_by, agg, c.y, c.x or "ts_ns")
        elif c.kind == "scatter":
            part = scatter(df, c.x or "x", c.y or "y")
        elif c.kind == "histogram":
            part = histogram(df, c.x or "value", c.bins, c.range)
        else:
            raise ValueError(f"unknown chart kind: {c.kind}")
        out.append(part.select(F.lit(c.id).alias("chart_id"), "series", "x", "y", "label"))
    return reduce(DataFrame.unionByName, out)


# -- largest-triangle downsampling -------------------------------------------------------------

def _hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Indices of the convex hull's corners, plus the first point at the left and right edge."""
    order = np.lexsort((y, x))
    keep = set()
    for seq in (order, order[::-1]):
        chain: list[int] = []
        for i in seq:
            while len(chain) >= 2:
                a, b = chain[-2], chain[-1]
                if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) <= 0:
                    chain.pop()
                else:
                    break
            chain.append(i)
        keep.update(chain)
    keep.add(int(np.argmin(x)))
    keep.add(int(np.argmax(x)))
    return sorted(int(k) for k in keep)


def lttb(df: DataFrame, x: str = "line_num", y: str = "y", n: int = 500, by=("source_id",),
         block_lines: int = BLOCK_LINES) -> DataFrame:
    """At most ``n`` points per series that keep its visual shape, with the series' full min and max.

    ``x`` is an integer position in series order. A bucket's pick is the point spanning the largest
    triangle with the previous pick and the next bucket's average. That area is the absolute
    value of a linear function of the point, so the pick is always a corner of the bucket's convex
    hull: buckets are reduced to hull corners in parallel (pieces of at most ``block_lines``
    points first), and only the corners of ``n`` buckets are walked in order.
    """
    by = list(by)
    pts = df.filter(F.col(y).isNotNull()).select(*by, F.col(x).cast("bigint").alias("x"), F.col(y).cast("double").alias("y"))
    ranked = rank_lines(pts, "i", keys=by, order=("x", "y"), block_lines=block_lines)
    totals = pts.groupBy(*by).agg(F.count("*").alias("total"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    size = (F.col("total") - 2) / F.lit(n - 2).cast("double")
    placed = ranked.join(totals, by)
    whole = (F.col("total") <= n) | F.lit(n < 3)
    # Bucket b (0-based) holds indices [floor(b*size+1), floor((b+1)*size+1)); guess, then correct for rounding.
    start = lambda b: F.floor(b * size + 1)
    guess = F.floor((F.col("i") - 1) / size)
    fixed = F.when(start(guess + 1) <= F.col("i"), guess + 1).when(start(guess) > F.col("i"), guess - 1).otherwise(guess)
    bucket = F.when(whole, F.lit(-1)).when(F.col("i") == 0, F.lit(-1)).when(
        F.col("i") >= start(F.lit(n - 2)), F.lit(n - 2)).otherwise(fixed).cast("bigint")
    placed = placed.withColumn("b", bucket)
    done = placed.filter(whole).select(*by, "x", "y", "min_y", "max_y")
    rest = placed.filter(~whole)

    sums = rest.groupBy(*by, "b").agg(F.avg("x").alias("ax"), F.avg("y").alias("ay"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pts.select(*by).schema)

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        """Corners of every bucket in one group of rows."""
        kept = []
        for _, g in pdf.sort_values("i").groupby("b", sort=False):
            kept.append(g if len(g) <= 2 else g.iloc[_hull(g["x"].to_numpy(float), g["y"].to_numpy(float))])
        return pd.concat(kept)[[*by, "b", "i", "x", "y"]]

    schema = f"{names}, b long, i long, x long, y double"
    body = rest.select(*by, "b", "i", "x", "y")
    # A piece holds at most block_lines points of one series, whatever the buckets; then the pieces' corners are merged.
    pieces = body.withColumn("_p", F.expr(f"i div {int(block_lines)}L")).groupBy(*by, "_p").applyInPandas(corners, schema)
    merged = pieces.withColumn("_p", F.expr("b div 64L")).groupBy(*by, "_p").applyInPandas(corners, schema)
    reduced = merged.join(sums, [*by, "b"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", kind="stable")
        groups = {b: g for b, g in pdf.groupby("b", sort=True)}
        first, last = groups[-1].iloc[0], groups[n - 2].iloc[-1]
        rows, prev = [first], first
        for b in range(n - 2):
            g = groups.get(b)
            if g is None:
                continue
            nxt = groups.get(b + 1)
            ax, ay = (nxt["ax"].iloc[0], nxt["ay"].iloc[0]) if nxt is not None else (last["x"], last["y"])
            gx, gy = g["x"].to_numpy(float), g["y"].to_numpy(float)
            area = np.abs((prev["x"] - ax) * (gy - prev["y"]) - (prev["x"] - gx) * (ay - prev["y"]))
            prev = g.iloc[int(np.argmax(area))]
            rows.append(prev)
        rows.append(last)
        out = pd.DataFrame(rows)
        return out[[*by, "x", "y"]]

    picked = reduced.groupBy(*by).applyInPandas(walk, f"{names}, x long, y double")
    picked = picked.join(totals.drop("total"), by)
    return done.unionByName(picked.select(*by, "x", "y", "min_y", "max_y"))


def minmax_downsample(df: DataFrame, x: str = "line_num", y: str = "y", buckets: int = 500, by=("source_id",)) -> DataFrame:
    """Lowest and highest point of each equal-width stretch: a cheap approximation for a first look."""
    by = list(by)
    pts = df.filter(F.col(y).isNotNull()).select(*by, F.col(x).alias("x"), F.col(y).cast("double").alias("y"))
    span = pts.groupBy(*by).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    b = F.least(F.floor((F.col("x") - F.col("_lo")) * buckets / (F.col("_hi") - F.col("_lo") + 1)), F.lit(buckets - 1))
    ends = pts.join(span, by).groupBy(*by, b.alias("_b")).agg(
        F.min_by(F.struct("x", "y"), F.struct("y", "x")).alias("lo"),
        F.max_by(F.struct("x", "y"), F.struct(F.col("y"), -F.col("x"))).alias("hi"))
    return ends.select(*by, F.inline(F.array_distinct(F.array("lo", "hi"))))
