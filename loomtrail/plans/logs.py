"""Event logs bound to the driver's tables, in Spark and as SQL for the oracle.

``user_log``: one case per user of ``events``.  ``day_log``: one case per user and day, so that
variants repeat.  ``order_log``: orders of a customer, with equal timestamps.  ``line_log``: lines
of an order, ordered by sequence numbers.  ``talk_log``: turns of a conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.plans.registry import table

FAILED = "FAILED"


def user_log(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("case_id"),
        F.col("event_type").alias("activity"),
        F.col("ts").alias("event_ts"),
        F.when(F.col("user_id") % 2 == 0, "WEB").otherwise("SHOP").alias("process_domain"),
        F.concat(F.lit("ORG-"), (F.col("user_id") % 4).cast("string")).alias("org_code"),
        F.when(F.col("event_type") == "error", FAILED).otherwise("OK").alias("result_code"),
        F.round((F.col("value") - 1.0) * 1000).cast("bigint").alias("duration_ms"),
        F.lit(None).cast("bigint").alias("source_sequence"),
        F.col("event_id").alias("ingest_sequence"),
        F.col("event_id").cast("string").alias("source_event_id"),
        F.lit("mapping-v1").alias("mapping_version"),
    )


USER_LOG = """log AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS case_id,
         event_type AS activity, ts AS event_ts,
         CASE WHEN user_id % 2 = 0 THEN 'WEB' ELSE 'SHOP' END AS process_domain,
         'ORG-' || CAST(user_id % 4 AS VARCHAR) AS org_code,
         CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'OK' END AS result_code,
         CAST(round((value - 1.0) * 1000) AS BIGINT) AS duration_ms,
         CAST(NULL AS BIGINT) AS source_sequence, event_id AS ingest_sequence,
         CAST(event_id AS VARCHAR) AS source_event_id
  FROM events)"""


def day_log(spark: SparkSession, folder: str) -> DataFrame:
    log = user_log(spark, folder)
    return log.withColumn(
        "case_id", F.concat_ws("-", "case_id", F.date_format("event_ts", "yyyyMMdd"))
    )


DAY_LOG = """log AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
         CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS case_id,
         event_type AS activity, ts AS event_ts,
         CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'OK' END AS result_code,
         'ORG-' || CAST(user_id % 4 AS VARCHAR) AS org_code,
         CAST(NULL AS BIGINT) AS source_sequence, event_id AS ingest_sequence,
         CAST(event_id AS VARCHAR) AS source_event_id
  FROM events)"""


def order_log(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("event_id"),
        F.col("o_custkey").cast("string").alias("case_id"),
        F.col("o_orderpriority").alias("activity"),
        F.col("o_orderdate").alias("event_ts"),
        F.col("o_orderstatus").alias("result_code"),
        F.lit(None).cast("bigint").alias("source_sequence"),
        F.col("o_orderkey").alias("ingest_sequence"),
        F.col("o_orderkey").cast("string").alias("source_event_id"),
    )


ORDER_LOG = """log AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS event_id, CAST(o_custkey AS VARCHAR) AS case_id,
         o_orderpriority AS activity, o_orderdate AS event_ts, o_orderstatus AS result_code,
         CAST(NULL AS BIGINT) AS source_sequence, o_orderkey AS ingest_sequence,
         CAST(o_orderkey AS VARCHAR) AS source_event_id
  FROM orders)"""


def line_log(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.select(
        F.lit(None).cast("string").alias("event_id"),
        F.col("l_orderkey").cast("string").alias("case_id"),
        F.concat("l_returnflag", "l_linestatus").alias("activity"),
        F.col("l_shipdate").alias("event_ts"),
        F.col("l_linenumber").cast("bigint").alias("source_sequence"),
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("source_event_id"),
        F.lit(None).cast("bigint").alias("ingest_sequence"),
    )


LINE_LOG = """log AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag || l_linestatus AS activity,
         l_shipdate AS event_ts, CAST(l_linenumber AS BIGINT) AS source_sequence,
         CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS source_event_id,
         CAST(NULL AS BIGINT) AS ingest_sequence
  FROM lineitem)"""


def talk_log(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    return c.select(
        F.lit(None).cast("string").alias("event_id"),
        F.col("conv_id").cast("string").alias("case_id"),
        F.col("role").alias("activity"),
        F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("event_ts"),
        F.col("turn").alias("source_sequence"),
        F.lit(None).cast("string").alias("source_event_id"),
        F.lit(None).cast("bigint").alias("ingest_sequence"),
    )


TALK_LOG = """log AS (
  SELECT CAST(conv_id AS VARCHAR) AS case_id, role AS activity,
         TIMESTAMP '2026-01-01 00:00:00' AS event_ts, turn AS source_sequence,
         CAST(NULL AS VARCHAR) AS source_event_id, CAST(NULL AS BIGINT) AS ingest_sequence
  FROM conversations)"""

# The event order, spelled for the oracle.
ORDERED = (
    "event_ts ASC NULLS LAST, source_sequence ASC NULLS LAST, "
    "source_event_id ASC NULLS LAST, ingest_sequence ASC NULLS LAST"
)

# Every event with its successor.
STEPS = f"""steps AS (
  SELECT *, lead(activity) OVER o AS target, lead(event_ts) OVER o AS next_ts,
         row_number() OVER o AS pos
  FROM log WINDOW o AS (PARTITION BY case_id ORDER BY {ORDERED}))"""

# Directly-follows pairs with all measures.
EDGES = """edges AS (
  SELECT activity AS source, target, count(*) AS transition_count,
         count(DISTINCT case_id) AS case_count,
         count(DISTINCT case_id) / (SELECT CAST(count(DISTINCT case_id) AS DOUBLE) FROM log) AS case_share,
         quantile_cont(date_diff('millisecond', event_ts, next_ts), 0.5) AS median_transition_ms,
         quantile_cont(date_diff('millisecond', event_ts, next_ts), 0.9) AS p90_transition_ms
  FROM steps WHERE target IS NOT NULL GROUP BY ALL)"""

# One row per case.
CASES = """cases AS (
  SELECT case_id, min(event_ts) AS first_ts, max(event_ts) AS last_ts, count(*) AS n,
         count(DISTINCT activity) AS kinds,
         date_diff('millisecond', min(event_ts), max(event_ts)) AS took
  FROM log GROUP BY case_id)"""

# One row per case with its sequence.
TRACES = f"""traces AS (
  SELECT case_id, sha256(string_agg(activity, chr(31) ORDER BY {ORDERED})) AS variant_hash,
         string_agg(activity, ' > ' ORDER BY {ORDERED}) AS seq, count(*) AS n,
         date_diff('millisecond', min(event_ts), max(event_ts)) AS took,
         count(*) > count(DISTINCT activity) AS rework
  FROM log GROUP BY case_id)"""

EDGE_COLUMNS = """source, target, transition_count, case_count, round(case_share, 6) AS case_share,
  round(median_transition_ms, 3) AS median_transition_ms, round(p90_transition_ms, 3) AS p90_transition_ms"""
