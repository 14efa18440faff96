"""Query of document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm import fingerprints as fp
from loomtrail.llm.neighbours import followers, id_of, key_of
from loomtrail.llm.registry import query, table
from loomtrail.llm.text_native import once


def with_edited(docs: DataFrame) -> DataFrame:
    """Every document with its next one's beginning and sketch.

    Where rows share an id, the next document is the row of that id with the smallest text hash.
    """
    texts = docs.select(key_of(F.col("doc_id")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    needs = followers(texts.groupBy("key").agg(F.max(half).alias("need")))
    lent = texts.join(needs.select(F.col("key").alias("to"), F.col("next_key").alias("key"), "need"), "key")
    lent = fp.with_sketch(lent.select("to", "need", "text"), "text", "next_sketch")
    lent = lent.select(
        F.col("to").alias("key"),
        F.xxhash64("text").alias("h"),
        F.struct(F.substr("text", F.lit(1), F.col("need")).alias("head"), "next_sketch").alias("next"),
    )
    first = lent.groupBy("key").agg(F.min_by("next", "h").alias("next"))
    return texts.join(first, "key").select("key", "text", "next.head", "next.next_sketch")


@query("op2_bottom_k_fingerprints")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_edited(table(spark, folder, "documents"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("head", F.lit(1), half))
    rows = fp.with_sketch(once(rows, edited=edited), "text", "sketch")
    rows = fp.with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        id_of(F.col("key")).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fp.as_text(F.col("sketch")).alias("fingerprint"),
        fp.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fp.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fp.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fp.containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"),
        F.round(fp.distinct_shingles(F.col("sketch"))).cast("long").alias("distinct_shingles"),
    )
