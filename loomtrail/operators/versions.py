"""Append-only registries: mapping, contract and artifact versions, batch ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE, SUPERSEDED = "ACTIVE", "SUPERSEDED"


def next_versions(datasets: DataFrame, registry: DataFrame) -> DataFrame:
    """Next version number per dataset, 1 when it has none."""
    newest = registry.groupBy("dataset_id").agg(F.max("version").alias("newest"))
    return (
        datasets.select("dataset_id")
        .join(newest, "dataset_id", "left")
        .select("dataset_id", (F.coalesce("newest", F.lit(0)) + 1).alias("next_version"))
    )


def with_status(registry: DataFrame) -> DataFrame:
    """The newest version of a dataset is active, all older ones are superseded.

    The maximum is combined before the shuffle and joined back, so a dataset with very many
    versions does not have to be sorted in one task.
    """
    newest = registry.groupBy("dataset_id").agg(F.max("version").alias("_newest"))
    status = F.when(F.col("version") == F.col("_newest"), ACTIVE).otherwise(SUPERSEDED)
    return registry.join(newest, "dataset_id").withColumn("status", status).drop("_newest")


def latest(registry: DataFrame) -> DataFrame:
    """The row with the highest version per dataset."""
    rest = [c for c in registry.columns if c != "dataset_id"]
    return (
        registry.groupBy("dataset_id")
        .agg(F.max_by(F.struct(*rest), "version").alias("r"))
        .select("dataset_id", "r.*")
    )


def active_artifacts(artifacts: DataFrame) -> DataFrame:
    """Mark the newest artifact of each dataset and type as active."""
    keys = ["dataset_id", "artifact_type"]
    newest = artifacts.groupBy(*keys).agg(F.max("version").alias("_newest"))
    return (
        artifacts.join(newest, keys)
        .withColumn("active", F.col("version") == F.col("_newest"))
        .drop("_newest")
    )


def removable_artifacts(artifacts: DataFrame) -> DataFrame:
    """Neither a source, nor active, nor pinned. The list only; nothing is deleted here."""
    return artifacts.filter((F.col("artifact_type") != "SOURCE") & ~F.col("active") & ~F.col("pinned"))


def storage_usage(artifacts: DataFrame) -> DataFrame:
    """Bytes per dataset by role of the artifact."""
    kind, size, active = F.col("artifact_type"), F.col("size_bytes"), F.col("active")
    derived = kind.isin("NORMALIZED", "QUARANTINE")

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, size)), F.lit(0))

    return artifacts.groupBy("dataset_id").agg(
        total(kind == "SOURCE").alias("raw_source"),
        total((kind == "NORMALIZED") & active).alias("normalized"),
        total((kind == "QUARANTINE") & active).alias("quarantine"),
        total(derived & ~active).alias("previous_versions"),
        total(kind == "TEMPORARY").alias("temporary"),
        total(F.lit(True)).alias("total"),
    )


def batch_ledger(
    events: DataFrame, rejected: DataFrame, batch_id: str, source_system: str, mapping_version: str, case_rule_version: str
) -> DataFrame:
    """One ledger row of a load: curated and rejected counts under the rule versions used."""
    return events.agg(F.count("*").alias("curated_row_count")).select(
        F.lit(batch_id).alias("ingestion_batch_id"),
        F.lit(source_system).alias("source_system"),
        (F.col("curated_row_count") + rejected.agg(F.count("*").alias("n")).scalar()).alias("raw_row_count"),
        "curated_row_count",
        rejected.agg(F.count("*").alias("n")).scalar().alias("rejected_row_count"),
        F.lit(mapping_version).alias("mapping_version"),
        F.lit(case_rule_version).alias("case_rule_version"),
        F.lit("COMPLETED").alias("status"),
    )
