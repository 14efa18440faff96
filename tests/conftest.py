import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("loomtrail-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="loomtrail-tests-"))
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


GOLDEN = [
    ("E001", "CASE-001", "A", "2026-01-01 09:00:00", 1),
    ("E002", "CASE-001", "B", "2026-01-01 09:01:00", 2),
    ("E003", "CASE-001", "C", "2026-01-01 09:03:00", 3),
    ("E004", "CASE-002", "A", "2026-01-01 10:00:00", 1),
    ("E005", "CASE-002", "B", "2026-01-01 10:02:00", 2),
    ("E006", "CASE-002", "B", "2026-01-01 10:05:00", 3),
    ("E007", "CASE-002", "C", "2026-01-01 10:09:00", 4),
    ("E008", "CASE-003", "A", "2026-01-01 11:00:00", 1),
    ("E009", "CASE-003", "D", "2026-01-01 11:01:00", 2),
    ("E010", "CASE-003", "C", "2026-01-01 11:07:00", 3),
]

RAW_COLUMNS = "event_id string, case_id string, activity string, event_ts string, source_sequence string"


def as_log(spark, rows):
    """Rows (event_id, case_id, activity, time text, sequence) as an event log."""
    df = spark.createDataFrame(rows, "event_id string, case_id string, activity string, t string, source_sequence long")
    return df.select(
        "event_id",
        "case_id",
        "activity",
        F.col("t").cast("timestamp_ntz").alias("event_ts"),
        "source_sequence",
        F.col("event_id").alias("source_event_id"),
        F.col("source_sequence").alias("ingest_sequence"),
    )


@pytest.fixture(scope="session")
def golden(spark):
    return as_log(spark, GOLDEN).cache()
