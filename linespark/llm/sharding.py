"""Sharding by jump consistent hashing, in DataFrame functions only.

A key seeds the 64-bit linear congruential generator of jump consistent hashing; its numbers tell at which shard counts the key
would jump, and the last jump below the real count is the key's shard.  No ring or table is kept: the shard follows from the key
and the number of shards alone, and with one more shard a key either stays or goes to the new one.  The jumps do not depend on the
number of shards, so one walk gives the shard for several counts.

Products modulo 2^64 are put together from 16-bit and 32-bit halves, which never overflow a bigint.

*Slots* number the rows of a shard without a gap.  A shard may hold any number of rows, so no window spans one: rows are stored with
their place in their task, ranked inside (task, shard), and moved up by what earlier tasks put into the shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import keep

SHARDS = 24
#: Multiplier of the generator of jump consistent hashing (fixed value).
MULTIPLIER = 2862933555777941757
#: Jumps walked for every key; the few keys that are not through by then walk on until they are.
STEPS = 64
_LOW = (1 << 32) - 1


def _times(x: Column, y: int) -> Column:
    """The lower 32 bits of a 32-bit number times a 32-bit constant."""
    lower, upper = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(y), F.shiftright(x, 16) * F.lit(y)
    return (lower.bitwiseAND(F.lit(_LOW)) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW))


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """``key * MULTIPLIER + 1`` modulo 2^64, the key given as two 32-bit halves."""
    a_hi, a_lo = MULTIPLIER >> 32, MULTIPLIER & _LOW
    upper = F.shiftright(lo, 16) * F.lit(a_lo)
    low = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(a_lo) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carried = F.shiftright(low, 32) + F.shiftright(upper, 16)
    return (carried + _times(hi, a_lo) + _times(lo, a_hi)).bitwiseAND(F.lit(_LOW)), low.bitwiseAND(F.lit(_LOW))


def jump_shards(key: Column, counts: list[int], steps: int = STEPS) -> list[Column]:
    """The shard of a bigint key for each number of shards; a null key is the key 0."""
    if not counts or min(counts) < 1:
        raise ValueError("shard counts must be at least 1")
    most, key = max(counts), F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next_key(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        landed = [F.when(s["j"] < n, s["j"]).otherwise(s[f"b{i}"]).alias(f"b{i}") for i, n in enumerate(counts)]
        return F.when(s["j"] < most, F.struct(hi.alias("hi"), lo.alias("lo"), jump.cast("bigint").alias("j"), *landed)).otherwise(s)

    walk = lambda s, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), s, step)
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_LOW)).alias("lo"), zero.alias("j"),
                     *[zero.alias(f"b{i}") for i in range(len(counts))])
    near = walk(start, min(steps, most))
    if most > steps:  # a walk of as many jumps as there are shards always ends
        near = F.element_at(F.transform(F.array(near), lambda s: F.when(s["j"] < most, walk(s, most)).otherwise(s)), 1)
    return [near[f"b{i}"].cast("int") for i in range(len(counts))]


def as_key(df: DataFrame, column: str) -> Column:
    """The column as a bigint key: integers as they are, anything else by a 64-bit hash of its text."""
    kind = df.schema[column].dataType.typeName()
    return F.col(column) if kind in ("byte", "short", "integer", "long") else F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column).cast("string")))


def assign_shards(rows: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``grown_shard`` (the shard if there were one more) to every row, without a shuffle.

    Rows with one key share a shard, rows with a null key are in shard 0. Input columns named like a result are replaced.
    """
    # An array of one struct, generated, computes the walk once for both columns.
    both = F.struct(*[c.alias(n) for c, n in zip(jump_shards(as_key(rows, key), [shards, shards + 1]), ("shard", "grown_shard"))])
    kept = [c for c in rows.columns if c not in ("shard", "grown_shard")]
    return rows.select(F.struct(*rows.columns).alias("_row"), F.explode(F.array(both)).alias("_at")).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in kept], "_at.shard", "_at.grown_shard")


def number_slots(placed: DataFrame, group: str = "shard") -> DataFrame:
    """Add ``slot``: the rows of every group numbered from 0 without a gap, in the order of the input's tasks.

    The table is stored on the way, which fixes the numbers whatever executor is lost later. An input column ``slot`` is replaced.
    """
    kept = [c for c in placed.columns if c != "slot"]
    stored = keep(placed.select(F.struct(*kept).alias("_row"), F.col(group).alias("_group"), F.monotonically_increasing_id().alias("_at"))
                  .withColumn("_task", F.shiftright("_at", 33)))
    cells = stored.groupBy("_task", "_group").agg(F.count("*").alias("_n"))  # tasks times groups
    earlier = W.partitionBy("_group").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    bases = cells.select(F.col("_task").alias("_t"), F.col("_group").alias("_g"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_task", "_group").orderBy("_at")  # never more rows than a task has read
    ranked = stored.withColumn("_place", F.row_number().over(inside) - 1)
    slots = ranked.join(bases, (F.col("_task") == F.col("_t")) & F.col("_group").eqNullSafe(F.col("_g")))
    return slots.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], (F.col("_base") + F.col("_place")).alias("slot"))


def shard_rows(rows: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """Add ``shard``, ``grown_shard`` and ``slot`` to every row; all other columns are carried along (and stored once).

    Null and repeated keys: see ``assign_shards``; repeated rows get a slot each; an empty table gives an empty table.
    """
    return number_slots(assign_shards(rows, shards, key))


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """Write the rows as one folder for each shard (``shard=0`` ...)."""
    shard_rows(rows, shards, key).write.partitionBy("shard").parquet(path)
