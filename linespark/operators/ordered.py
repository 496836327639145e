"""Ordered operators that stay parallel when one source holds most of the rows.

A plain ``Window.partitionBy("source_id").orderBy("line_num")`` puts a whole
source into one task.  Every operator here works on *blocks* instead: a block is
``line_num div block_lines``, and because ``line_num`` is unique inside a source a
block never holds more than ``block_lines`` rows per key, whatever the skew.

* :func:`scan` - running values.  The rows are shuffled once by key and block. One aggregate
  per block gives the value carried into each block (a window over one row per block),
  then a window inside each block finishes the row.
* :func:`halo` - look-back or look-ahead of bounded reach.  Rows near a block edge are
  also given to the neighbour block, so any bounded frame can be computed there.
* :func:`global_rank` - dense positions under an arbitrary order, from a
  range-partitioned, sorted, checkpointed copy; ranks never need a single-task sort.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

BLOCK_LINES = 1 << 18


def _block(position: str, block_lines: int) -> Column:
    return F.expr(f"`{position}` div {int(block_lines)}L")


def scan(df: DataFrame, *, keys=("source_id",), order=("line_num",), block_lines: int = BLOCK_LINES,
         prev: dict[str, Column] | None = None, last: dict[str, Column] | None = None,
         next: dict[str, Column] | None = None, before: dict[str, Column] | None = None,
         peak: dict[str, Column] | None = None) -> DataFrame:
    """Add running columns per key, in order.

    ``prev``   most recent non-NULL value strictly before the row
    ``last``   most recent non-NULL value up to and including the row
    ``next``   first non-NULL value strictly after the row
    ``before`` running sum strictly before the row (0 when there is none)
    ``peak``   running maximum strictly before the row

    ``order[0]`` must be a non-negative integer position, few rows per key and
    position; further entries break ties. Rows whose key or position is NULL have no place in the order
    and are left out.
    """
    prev, last, next, before, peak = (d or {} for d in (prev, last, next, before, peak))
    keys, order = list(keys), list(order)
    value = {}
    for kind, d in (("p", prev), ("l", last), ("n", next), ("b", before), ("k", peak)):
        for name, c in d.items():
            value[f"_{kind}_{name}"] = c
    staged = df.withColumns({**value, "_block": _block(order[0], block_lines)})
    # The rest of the row travels as one opaque value. Both uses below then need the same columns, so Spark
    # computes and shuffles the rows once and reuses that exchange instead of running the input twice.
    rest = [c for c in staged.columns if c not in keys and c != "_block"]
    placed = staged
    for c in (*keys, "_block"):
        placed = placed.filter(F.col(c).isNotNull())
    packed = placed.select(*keys, "_block", F.array(F.struct(*rest)).alias("_row")).repartition(*keys, "_block")
    item = F.element_at("_row", 1)
    at = lambda c: F.col(c) if c in keys else item.getField(c)
    pos = F.struct(*[at(o).alias(o) for o in order])

    aggs = []
    for v in value:
        kind, x = v[1], at(v)
        seen = F.when(x.isNotNull(), pos)
        if kind in "pl":
            aggs.append(F.max_by(x, seen).alias(v))
        elif kind == "n":
            aggs.append(F.min_by(x, seen).alias(v))
        elif kind == "b":
            aggs.append(F.sum(x).alias(v))
        else:
            aggs.append(F.max(x).alias(v))
    blocks = packed.groupBy(*keys, "_block").agg(*aggs)

    by_block = W.partitionBy(*keys).orderBy("_block")
    earlier = by_block.rowsBetween(W.unboundedPreceding, -1)
    # Looking ahead is looking back in the reverse order: frames open at the far end cost quadratic time.
    later = W.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    carried = []
    for v in value:
        kind = v[1]
        c = {"p": lambda: F.last(v, ignorenulls=True).over(earlier),
             "l": lambda: F.last(v, ignorenulls=True).over(earlier),
             "n": lambda: F.last(v, ignorenulls=True).over(later),
             "b": lambda: F.sum(v).over(earlier),
             "k": lambda: F.max(v).over(earlier)}[kind]()
        carried.append(c.alias(f"_in{v}"))
    carry = blocks.select(*keys, "_block", *carried)

    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    up_to_prev = inside.rowsBetween(W.unboundedPreceding, -1)
    up_to_here = inside.rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*keys, "_block").orderBy(*[F.desc(o) for o in order]).rowsBetween(W.unboundedPreceding, -1)
    result = {}
    for v in value:
        kind, name, c_in = v[1], v[3:], F.col(f"_in{v}")
        if kind == "p":
            result[name] = F.coalesce(F.last(v, ignorenulls=True).over(up_to_prev), c_in)
        elif kind == "l":
            result[name] = F.coalesce(F.last(v, ignorenulls=True).over(up_to_here), c_in)
        elif kind == "n":
            result[name] = F.coalesce(F.last(v, ignorenulls=True).over(after), c_in)
        elif kind == "b":
            zero = F.lit(0)
            result[name] = F.coalesce(F.sum(v).over(up_to_prev), zero) + F.coalesce(c_in, zero)
        else:
            result[name] = F.greatest(F.max(v).over(up_to_prev), c_in)
    joined = packed.join(carry, [*keys, "_block"])
    out = joined.select(*keys, "_block", *[f"_in{v}" for v in value], F.inline_outer("_row")).withColumns(result)
    helpers = {*value, *(f"_in{v}" for v in value), "_block"} - set(result)
    kept = [c for c in df.columns if c not in result]
    return out.drop(*helpers).select(*kept, *result)


def rank_lines(df: DataFrame, name: str = "rank", keys=("source_id",), order=("line_num",),
               block_lines: int = BLOCK_LINES) -> DataFrame:
    """0-based dense position of each row inside its key."""
    return scan(df, keys=keys, order=order, before={name: F.lit(1).cast("bigint")}, block_lines=block_lines)


def halo(df: DataFrame, *, position: str = "line_num", before: int = 0, after: int = 0,
         block_lines: int = BLOCK_LINES) -> DataFrame:
    """Give each row to its block and to the neighbours it can be seen from.

    Adds ``_block`` and ``_own``. Frames reaching ``before`` positions back or
    ``after`` positions ahead are complete for rows with ``_own``; the caller windows by
    key and ``_block`` and keeps only those rows.
    """
    size = max(int(block_lines), before, after, 1)
    pos = F.col(position)
    home = _block(position, size)
    reach = F.sequence(F.greatest((F.expr(f"(`{position}` - {int(after)}L) div {size}L")), F.lit(0)),
                       F.expr(f"(`{position}` + {int(before)}L) div {size}L"))
    edge = (pos % size >= size - before) | (pos % size < after)
    near = df.withColumn("_block", F.explode(F.when(edge, reach).otherwise(F.array(home))))
    return near.withColumn("_own", F.col("_block") == home)


def look_back(df: DataFrame, n: int, values: dict[str, Column], *, keys=("source_id",), order=("line_num",),
              block_lines: int = BLOCK_LINES) -> DataFrame:
    """Array per value of the up to ``n`` preceding rows, most recent first."""
    ranked = rank_lines(df, "_rank", keys, order, block_lines)
    near = halo(ranked, position="_rank", before=n, block_lines=block_lines)
    w = W.partitionBy(*keys, "_block").orderBy("_rank").rowsBetween(-n, -1)
    cols = {name: F.reverse(F.collect_list(c).over(w)) for name, c in values.items()}
    return near.withColumns(cols).filter("_own").drop("_rank", "_block", "_own")


def lag_rows(df: DataFrame, values: dict[str, tuple[Column, int]], *, keys=("source_id",), order=("line_num",),
             block_lines: int = BLOCK_LINES) -> DataFrame:
    """``{out: (column, n)}``: the column's value ``n`` rows earlier inside the key."""
    reach = max(n for _, n in values.values())
    ranked = rank_lines(df, "_rank", keys, order, block_lines)
    near = halo(ranked, position="_rank", before=reach, block_lines=block_lines)
    w = W.partitionBy(*keys, "_block").orderBy("_rank")
    cols = {name: F.lag(c, n).over(w) for name, (c, n) in values.items()}
    return near.withColumns(cols).filter("_own").drop("_rank", "_block", "_own")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only for a local session without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="linespark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def settle(df: DataFrame) -> DataFrame:
    """Compute a result that several later steps need once and keep it in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def global_rank(df: DataFrame, order: list, name: str = "rank", within=(), partitions: int | None = None) -> DataFrame:
    """0-based dense rank of every row under ``order``, optionally within groups.

    Range partitioning spreads even one huge group over all tasks as long as the order
    is total. The sorted rows are checkpointed with their position inside the partition,
    so that a lost executor cannot change it between the count and the use. Only the
    per-partition counts (partitions x groups at partition edges) are windowed.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    within = list(within)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cols = [F.col(c) if isinstance(c, str) else c for c in (*within, *order)]
    placed = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .withColumn("_at", F.monotonically_increasing_id()).checkpoint())
    placed = placed.withColumns({"_part": F.shiftright("_at", 33)})
    counts = placed.groupBy("_part", *within).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_part", *within, "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    joined = placed.join(starts, ["_part", *within])
    return joined.withColumn(name, F.col("_base") + F.col("_at") - F.col("_first")).select(*df.columns, name)


def out_of_order(df: DataFrame, keys=("source_id",), order=("line_num",), block_lines: int = BLOCK_LINES) -> DataFrame:
    """Rows whose time is earlier than an earlier row of the same key (should be none for bursts)."""
    seen = scan(df, keys=keys, order=order, peak={"_max_ts": F.col("ts_ns")}, block_lines=block_lines)
    return seen.filter(F.col("ts_ns") < F.col("_max_ts")).drop("_max_ts")
