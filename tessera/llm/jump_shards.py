"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable 64-bit key walks through the shard counts 1, 2, 3, ... by jumps drawn
from a linear congruential generator seeded with the key; the last landing
below the shard count is the shard. No ring table exists, and appending a
shard moves a row only into the new shard.

Everything runs as Column expressions. Spark's arithmetic raises on overflow,
so the generator's 64-bit product is put together from 32- and 16-bit limbs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

# The generator's multiplier and increment.
MULTIPLIER = 2862933555777941757
INCREMENT = 1

_LOW = 0xFFFFFFFF
#: Steps taken for every key before the rare longer walks go on alone.
_FIRST_STEPS = 24


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + INCREMENT modulo 2**64, in halves of 32 bits."""
    c_hi, c_lo = MULTIPLIER >> 32, MULTIPLIER & _LOW

    def low_product(x: Column, c: int) -> Column:
        upper = F.shiftleft((x * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
        return x * F.lit(c & 0xFFFF) + upper

    below = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(c_lo)
    above = F.shiftright(lo, 16) * F.lit(c_lo)
    low = below + F.shiftleft(above.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(INCREMENT)
    high = F.shiftright(low, 32) + F.shiftright(above, 16) + low_product(hi, c_lo) + low_product(lo, c_hi)
    return high.bitwiseAND(F.lit(_LOW)), low.bitwiseAND(F.lit(_LOW))


def key64(key: Column, kind: T.DataType) -> Column:
    """The 64-bit key: an integer column is its own key, others are hashed.

    A null key counts as 0.
    """
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(key.isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(key))


def jump_hash(key: Column, counts: list[int]) -> Column:
    """Array of shards, one for each of `counts`, from one walk of the bigint `key`."""
    if not counts or min(counts) < 1:
        raise ValueError("shard counts must be 1 or more")
    most = max(counts)

    def step(state: Column, _: Column) -> Column:
        j = state["j"]
        hi, lo = _next(state["hi"], state["lo"])
        after = F.struct(hi.alias("hi"), lo.alias("lo"))
        # The draw is the top 31 bits of the generator's state.
        landed = F.transform(F.array(after), lambda s: F.struct(
            s["hi"].alias("hi"),
            s["lo"].alias("lo"),
            F.floor((j + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(s["hi"], 1) + 1).cast("double"))).cast("bigint").alias("j"),
            F.array(*[F.when(j < n, j).otherwise(state["b"][i]) for i, n in enumerate(counts)]).alias("b"),
        ))[0]
        return F.when(j < most, landed).otherwise(state)

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(_LOW)).alias("lo"),
        F.lit(0).cast("bigint").alias("j"),
        F.array(*[F.lit(0).cast("bigint") for _ in counts]).alias("b"),
    )
    first = min(_FIRST_STEPS, most)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(first)), start, step)
    if first < most:
        # At most `most` jumps exist; nearly every walk is over by now.
        walked = F.transform(F.array(walked), lambda s: F.when(s["j"] < most, F.aggregate(F.sequence(F.lit(first + 1), F.lit(most)), s, step)).otherwise(s))[0]
    return walked["b"]


def assign_shards(df: DataFrame, key: str, n_shards: int, shard: str = "shard", grown: str | None = None) -> DataFrame:
    """`df` with the shard of each row, and with `grown` the shard at one shard more.

    No shuffle. Rows with equal keys share a shard, null keys that of key 0;
    an empty table stays empty. A column already named like an output is replaced.
    """
    counts = [n_shards] + ([n_shards + 1] if grown else [])
    walk = jump_hash(key64(F.col(f"`{key}`"), df.schema[key].dataType), counts)
    out = df.withColumn("__walk", walk)
    out = out.withColumn(shard, F.col("__walk")[0].cast("int"))
    if grown:
        out = out.withColumn(grown, F.col("__walk")[1].cast("int"))
    return out.drop("__walk")


def assign_slots(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """`df` with a gapless slot from 0 in each shard, by `order`, nulls first.

    One range shuffle by (shard, order, row) cuts hot shards and hot keys alike;
    the slot is the row's place in its partition plus the rows of the shard in
    earlier partitions. Pass narrow rows. Rows equal in `order` get slots in any order.
    """
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in (shard, *order, "__row")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = materialize(placed.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()).drop("__row"), "slots")
    runs = placed.groupBy("__part", F.col(f"`{shard}`").alias("__shard")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # One row for each partition and shard met: at most partitions + shards rows.
    before = Window.partitionBy("__shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(F.col("__part").alias("__p"), "__shard", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = placed.join(F.broadcast(starts), (F.col("__part") == F.col("__p")) & (F.col(f"`{shard}`") == F.col("__shard")))
    return out.withColumn(slot, (F.col("__at") - F.col("__first") + F.col("__before")).cast("bigint")).drop("__part", "__p", "__shard", "__at", "__first", "__before")
