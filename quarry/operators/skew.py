"""Joins and ranks that hold when one key owns a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut

HEAVY_KEYS = 1024


def heavy_keys(df: DataFrame, key: str, most: int = HEAVY_KEYS) -> DataFrame:
    """Keys with more than one row in ``most``; so there are fewer than ``most`` of them.

    Null keys are not reported.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    limit = df.count() / most
    return counts.where(F.col("count") > limit).select(key)


def lookup_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join of ``left`` to ``right``, which holds each ``key`` once.

    Rows of the left's heavy keys meet a broadcast of their (fewer than
    ``HEAVY_KEYS``) matching rows; all others are shuffled, so no task gets
    a heavy key.  Both inputs are read several times: cut them before.
    """
    heavy = F.broadcast(heavy_keys(left, key).withColumn("_heavy", F.lit(True)))
    flagged = left.join(heavy, key, "left")
    hot = flagged.where("_heavy").drop("_heavy")
    cold = flagged.where(F.col("_heavy").isNull()).drop("_heavy")
    hot_right = F.broadcast(right.join(heavy.drop("_heavy"), key, "left_semi"))
    return hot.join(hot_right, key, "left").unionByName(cold.join(right, key, "left"))


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Exact 1-based rank in the total order of the columns ``order`` (ascending).

    Rows are range partitioned; only each partition's row count is gathered,
    so no window runs over the whole table.
    """
    parts = df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id())
    parts = cut(parts)
    sizes = parts.groupBy("_pid").count()
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_pid").orderBy(*order)
    return (
        parts.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_before") + F.row_number().over(within))
        .drop("_before")
    )
