"""Global rank and running total without pulling all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, broadcast_checked, stage


def ranked_running_total(
    df: DataFrame, order: list[Column], value: str, policy: ScalePolicy = DEFAULT_POLICY
) -> DataFrame:
    """Add ``rank`` (1, 2, ...) and ``running_total`` of ``value`` in the given total order."""
    cut = stage(
        df.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()), "ranked"
    )
    # One row per range partition.
    along = W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    before = (
        cut.groupBy("_piece")
        .agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"))
        .select(
            "_piece",
            F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_n0"),
            F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_sum0"),
        )
    )
    inside = W.partitionBy("_piece").orderBy(*order)
    return (
        cut.withColumn("_r", F.row_number().over(inside))
        .withColumn("_t", F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .join(broadcast_checked(before, policy), "_piece")
        .withColumn("rank", (F.col("_r") + F.col("_n0")).cast("bigint"))
        .withColumn("running_total", F.col("_t") + F.col("_sum0"))
        .drop("_piece", "_n0", "_sum0", "_r", "_t")
    )
