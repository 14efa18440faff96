"""Query of the pseudonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm import pii
from loomtrail.llm.registry import query, table


@query("op4_feistel_pseudonyms")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.pseudonymize(docs, key="production-key")
    return found.select(
        "doc_id",
        "text",
        F.size("findings").cast("long").alias("n_found"),
        F.array_join(F.sort_array(F.array_distinct(F.transform("findings", lambda f: f["kind"]))), ",").alias("kinds"),
    )
