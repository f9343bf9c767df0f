"""Exact ranks and running values where one key may hold any share of the rows: keys are cut into blocks by order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of a hot key. A key is hot if it holds 1/BLOCKS of the rows or more, so there are at most BLOCKS of them.
BLOCKS = 256


def in_blocks(df: DataFrame, key: str, number: Column) -> DataFrame:
    """``df`` with block: ranges of ``number`` (a double that follows the order wanted) within each hot key, 0 elsewhere.

    Borders come from a quantile sketch, whose size is bounded; they bound the size of blocks, not what results are.
    """
    rows = df.withColumn("_x", number.cast("double"))
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"), F.percentile_approx("_x", [i / BLOCKS for i in range(1, BLOCKS)], 10 * BLOCKS).alias("_cuts"))
    total = rows.agg(F.count("*").alias("_total"))
    hot = sizes.crossJoin(F.broadcast(total)).filter(F.col("_n") * BLOCKS >= F.col("_total")).select(F.col(key).alias("_key"), "_cuts")  # total is one row
    joined = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_key")), "left")
    block = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_x"))), F.lit(0))
    return joined.withColumn("block", F.when(F.col("_cuts").isNull(), 0).otherwise(block)).drop("_x", "_key", "_cuts")


def values_at(df: DataFrame, key: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(key, n, and for each name of ``ranks`` the value at that rank): ranks count from 0 and may use n, the rows of the key.

    Equal values are counted before anything is ordered; then only the blocks that hold a rank asked for are.
    """
    counts = in_blocks(df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c")), key, F.col(value))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(key, "block").agg(F.sum("c").alias("m"))  # at most BLOCKS rows a key
    blocks = blocks.withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0))).withColumn("n", F.sum("m").over(Window.partitionBy(key)))
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("at")) for name, r in ranks.items()]))
    asked = blocks.select(key, "block", "start", "m", "n", named.alias("r")).filter((F.col("r.at") >= F.col("start")) & (F.col("r.at") < F.col("start") + F.col("m")))
    held = counts.join(asked.select(key, "block", "start").distinct(), [key, "block"])
    order = Window.partitionBy(key, "block").orderBy(value)
    held = held.withColumn("to", F.col("start") + F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    hit = held.select(key, "block", "c", F.col(value).alias("_v"), "to").join(asked.select(key, "block", "n", "r"), [key, "block"]).filter((F.col("r.at") < F.col("to")) & (F.col("r.at") >= F.col("to") - F.col("c")))
    return hit.groupBy(key).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("r.name") == name, F.col("_v"))).alias(name) for name in ranks])


def places(df: DataFrame, key: str, number: Column, order: list[str]) -> DataFrame:
    """``df`` with block and i, the row's place (from 0) in its key by ``order``, which ``number`` follows."""
    rows = in_blocks(df, key, number)
    sizes = rows.groupBy(key, "block").agg(F.count("*").alias("m"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(key).alias("_key"), F.col("block").alias("_block"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(key, "block").orderBy(*order)) - 1
    joined = rows.withColumn("_r", rank).join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")))
    return joined.withColumn("i", F.col("_start") + F.col("_r")).drop("_key", "_block", "_start", "_r")


def running_max(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``df``, as :func:`places` gives it, with the largest ``value`` so far in the row's key."""
    rows = df.withColumn("_v", value)
    most = rows.groupBy(key, "block").agg(F.max("_v").alias("m"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = most.select(F.col(key).alias("_key"), F.col("block").alias("_block"), F.max("m").over(before).alias("_before"))
    here = F.max("_v").over(Window.partitionBy(key, "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("_here", here).join(earlier, F.col(key).eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")))
    return joined.withColumn(name, F.greatest("_here", "_before")).drop("_v", "_key", "_block", "_before", "_here")
