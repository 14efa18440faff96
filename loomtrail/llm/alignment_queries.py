"""Query of cross-tokenizer alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtrail.llm import alignment
from loomtrail.llm.registry import query, table


@query("op12_tokenizer_span_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"))
