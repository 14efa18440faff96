"""Queries of best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm import packing
from loomtrail.llm.registry import query, table
from loomtrail.scale import stage


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pieces = stage(packing.token_pieces(table(spark, folder, "documents")), "packing-pieces")
    return packing.place(digest(pieces))
