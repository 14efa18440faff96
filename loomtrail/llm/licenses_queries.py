"""Query of the license scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtrail.llm import licenses
from loomtrail.llm.registry import query, table


@query("op6_license_diagonals")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))
