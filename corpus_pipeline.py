"""The corpus pipeline: documents are cleaned, freed of near copies, pseudonymized and packed.

Every stage is written as Parquet and read again before the next one starts. All but the last return the
columns of ``documents``; the last returns packed pieces with their token ids. Rows that share a ``doc_id``
are one document after the second stage; of rows without one, a text stays once. Other columns pass
through until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.llm import near_dedup, packing, pii, quality
from loomtrail.llm.code import ship
from loomtrail.scale import staged_path

#: No SQL states near-duplicate components, keyed permutations or token ids.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with their cleaned texts."""
    return quality.clean_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest ``doc_id``."""
    ship(spark)
    judged = near_dedup.near_duplicates(docs)
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )
    rest = rows.join(judged.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti")
    # Rows that repeat an id are one document; those without an id are told apart by their texts. Smallest
    # rows are found before the shuffle, so that one text may have most of the rows.
    apart = F.when(F.col("doc_id").isNull(), F.col("h"))
    first = rest.groupBy("doc_id", apart.alias("apart")).agg(F.min_by("row", "h").alias("row"))
    return first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    # A column of the name that the findings get is set aside.
    found = pii.pseudonymize(docs.withColumnRenamed("findings", "_own_findings"), key="production-key")
    new = {"n_chars": F.length("text").cast("long"), "findings": F.col("_own_findings")}
    return found.select(*[(new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("pseudonyms", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = staged_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
