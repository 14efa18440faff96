"""Query of main texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm import html_text
from loomtrail.llm.registry import query, table


@query("op8_host_repeats_main_text")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
