"""Queries of token-id files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm import tokenfiles
from loomtrail.llm.registry import query, table
from loomtrail.scale import staged_path


@query("op9_repair_token_files")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    path = staged_path(spark, "token-files")
    tokenfiles.write_shards(table(spark, folder, "documents"), path)
    shards = tokenfiles.read_shards(spark, path)
    found = tokenfiles.read_documents(shards).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return found.join(tokenfiles.shard_starts(shards), ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32"
    )
