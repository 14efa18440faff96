"""The document after each one in descending order of ids, round and round, without a global sort task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtrail.scale import stage

NO_ID = -(2**63)


def key_of(doc_id: Column) -> Column:
    """Rows without an id come last."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def id_of(key: Column) -> Column:
    return F.when(key != NO_ID, key)


def followers(keys: DataFrame) -> DataFrame:
    """``next_key`` for the rows of ``keys``, one per ``key``."""
    parted = keys.repartitionByRange(F.col("key").desc()).withColumn("part", F.spark_partition_id())
    parted = stage(parted, "neighbours")
    inside = W.partitionBy("part").orderBy(F.col("key").desc())
    parts = parted.groupBy("part").agg(F.max("key").alias("first"))
    # One row per partition written.
    in_order = W.orderBy("part")
    every = in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    parts = parts.select(
        "part", F.coalesce(F.lead("first").over(in_order), F.first("first").over(every)).alias("next_first")
    )
    return (
        parted.withColumn("next_key", F.lead("key").over(inside))
        .join(parts, "part")
        .withColumn("next_key", F.coalesce("next_key", "next_first"))
        .drop("part", "next_first")
    )
