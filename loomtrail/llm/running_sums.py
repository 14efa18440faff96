"""Running sums along an order within keys, of which one may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtrail.scale import stage


def running_sums(rows: DataFrame, key: str, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums of ``values`` per ``key`` in the given order.

    A range shuffle cuts the rows into parts that follow each other. Sums run inside a part; only a key that lies
    in several parts needs more: the sums of the parts before, of which there are two rows a part at most.
    """
    named = rows.select("*", *[value.alias(f"_{name}") for name, value in values.items()])
    cut = stage(
        named.repartitionByRange(F.col(key).asc(), *order).withColumn("_part", F.spark_partition_id()), "running"
    )
    edges = cut.groupBy("_part").agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("_keys"))
    edges = edges.select("_part", F.explode("_keys").alias(key))
    totals = cut.join(F.broadcast(edges), ["_part", key]).groupBy("_part", key).agg(
        *[F.sum(f"_{name}").alias(f"_all_{name}") for name in values]
    )
    earlier = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("_part", key, *[F.sum(f"_all_{name}").over(earlier).alias(f"_all_{name}") for name in values])
    inside = W.partitionBy("_part", key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = cut.select(*rows.columns, "_part", *[F.sum(f"_{name}").over(inside).alias(f"_{name}") for name in values])
    return summed.join(F.broadcast(before), ["_part", key], "left").select(
        *rows.columns, *[(F.col(f"_{name}") + F.coalesce(f"_all_{name}", F.lit(0))).alias(name) for name in values]
    )
