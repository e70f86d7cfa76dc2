"""Positions in a global order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelpay.sources.stage import Stage

#: monotonically_increasing_id() has the row's number within its partition in the lower 33 bits.
_ROW_BITS = (1 << 33) - 1


def ordinal_positions(ids: DataFrame, column: str, stage: Stage | None = None) -> DataFrame:
    """(id, position, total): zero-based position of each distinct id in text order; nulls first, if any.

    Two passes. The first stores the distinct ids in ranges, sorted and numbered within each range. The second counts
    the ranges, so that the number of ids in earlier ranges is added to a row's own number. The ranges are stored, since
    they are sampled and another run of the same plan might cut them elsewhere.
    """
    stage = stage or Stage(ids.sparkSession)
    key = F.col(column)
    ranged = ids.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    numbered = ranged.select(
        key,
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("within"),
    )
    placed = stage.put(numbered, "positions")
    # One row per range, so this window never sees the ids.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        placed.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "part",
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"),
            F.sum("n").over(Window.partitionBy()).alias("total"),
        )
    )
    return placed.join(ranges, "part").select(
        column, (F.col("within") + F.col("ahead")).cast("bigint").alias("position"), "total"
    )


def split_pool(ids: DataFrame, pool_cents: int, column: str = "dispatcher_key", stage: Stage | None = None) -> DataFrame:
    """Equal share of a pool per distinct id, in cents that sum exactly to the pool.

    Left-over cents go, one each, to the first ids in text order.
    """
    pool = F.lit(pool_cents).cast("bigint")
    cents = F.expr(f"{int(pool_cents)}L div total") + F.when(F.col("position") < pool % F.col("total"), 1).otherwise(0)
    positions = ordinal_positions(ids, column, stage)
    return positions.select(column, (cents / 100).cast("decimal(18,2)").alias("share"))
