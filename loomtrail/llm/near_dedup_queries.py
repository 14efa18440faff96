"""Query of near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtrail.llm import near_dedup
from loomtrail.llm.registry import query, table


@query("op5_hyperminhash_near_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), size=4)
