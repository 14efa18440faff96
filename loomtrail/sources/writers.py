"""Parquet sinks and all-or-nothing publication of log versions."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.operators.normalize import NormalizedLog
from loomtrail.sources import commits

PUBLICATIONS = (
    "dataset_id string, version int, events_path string, quarantine_path string, published_at timestamp_ntz"
)


def write_parquet(df: DataFrame, path: str) -> str:
    """ZSTD Parquet; never over existing data."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return path


def write_partitioned(df: DataFrame, path: str, by: list[str], rows_per_file: int = 5_000_000) -> str:
    """Directory layout by the given columns.

    The rebalance groups rows by directory to avoid small files, and adaptive execution splits a
    directory that holds most of the rows.
    """
    (
        df.hint("rebalance", *[F.col(c) for c in by])
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*by)
        .parquet(path)
    )
    return path


def publish(spark: SparkSession, log: NormalizedLog, root: str, dataset_id: str, version: int) -> DataFrame:
    """Write quarantine and events of a version, then put the commit in place that makes it visible.

    Every attempt writes folders of its own, so a run that failed anywhere before its commit is repeated under the same
    version. Of two publishers of one version the second to commit gets ``CommitConflict``, before it writes if it can
    be seen by then. Readers go through ``current_events``; ``orphans`` lists what no commit names.
    """
    base = f"{root.rstrip('/')}/{dataset_id}"
    if not publications(spark, root, dataset_id).where(F.col("version") == version).isEmpty():
        raise commits.CommitConflict(f"version {version} of {dataset_id} is published")
    attempt = f"v={version}/attempt={uuid.uuid4().hex}"
    rejected = write_parquet(log.quarantine, f"{base}/quarantine/{attempt}")
    events = write_parquet(log.events, f"{base}/events/{attempt}")
    values = {
        "dataset_id": dataset_id, "version": version, "events_path": events, "quarantine_path": rejected,
        "published_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f"),
    }
    commits.commit(spark, f"{base}/published", version, values)
    return publications(spark, root, dataset_id)


def publications(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    return commits.committed(spark, f"{root.rstrip('/')}/{dataset_id}/published", PUBLICATIONS)


def current_events(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """Events of the newest published version."""
    newest = publications(spark, root, dataset_id).orderBy(F.desc("version")).first()
    if newest is None:
        raise ValueError(f"nothing published for {dataset_id}")
    return spark.read.parquet(newest["events_path"])


def orphans(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """Folders of attempts that no commit names, with their last change: failed runs, and those still on their way."""
    base = f"{root.rstrip('/')}/{dataset_id}"
    found = [
        (f"{base}/{kind}/{version}/{name}", datetime.fromtimestamp(at / 1000, timezone.utc).replace(tzinfo=None))
        for kind in ("events", "quarantine")
        for version, _ in commits.folders(spark, f"{base}/{kind}")
        for name, at in commits.folders(spark, f"{base}/{kind}/{version}")
    ]
    listed = spark.createDataFrame(found, "path string, modified_at timestamp_ntz")
    known = publications(spark, root, dataset_id)
    named = known.select(F.explode(F.array("events_path", "quarantine_path")).alias("path"))
    return listed.join(named, "path", "left_anti")
