"""Query of the conversation prefix trie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm import prefix_trie
from loomtrail.llm.registry import query, table
from loomtrail.scale import stage

#: Turns of one conversation that a join sees under one key.
SPAN = 1 << 16


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations that begin with the first turns of the one whose id is the multiple of 20 below."""
    turn = ["place", "h1", "h2", "words"]
    n_taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    first = turns.where((F.pmod("conv_id", F.lit(20)) == 0) & (F.col("place") <= 3)).groupBy(
        F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct(*turn))).alias("first"))
    with_base = sizes.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(20))).join(first, "base", "left")
    taken = F.coalesce(F.slice("first", F.lit(1), n_taken), F.array().cast(first.schema["first"].dataType))
    with_base = stage(with_base.select("conv_id", "n", taken.alias("taken")), "rebuilt")
    # A shorter base moves the own turns up.
    moved = with_base.withColumn("by", n_taken - F.size("taken")).where("by > 0").select(
        "conv_id", "by", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {SPAN}"))).alias("span")
    )
    own = turns.where(F.col("place") > n_taken).withColumn("span", F.expr(f"place div {SPAN}"))
    own = own.join(moved, ["conv_id", "span"], "left").withColumn("place", F.col("place") - F.coalesce("by", F.lit(0)))
    begin = with_base.select("conv_id", F.inline("taken"))
    return begin.unionByName(own.select("conv_id", *turn)), with_base.select("conv_id")


@query("op11_conversation_prefix_trie")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    turns = stage(prefix_trie.ordered_turns(table(spark, folder, "conversations")), "ordered-turns")
    return prefix_trie.prefix_trie(*rebuilt(turns))
