"""Query of subword encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm import subwords
from loomtrail.llm.registry import query, table


@query("op3_merge_dropout_pieces")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    encoded = subwords.encode_documents(table(spark, folder, "documents"), seed=2026)
    back = subwords.decode_documents(encoded)
    return back.select(
        "doc_id",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.char_length("text").cast("long").alias("n_decoded"),
        (F.xxhash64("text") == F.col("text_hash")).alias("lossless"),
    )
