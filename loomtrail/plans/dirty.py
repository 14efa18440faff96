"""A raw log with deterministic damage, derived from ``events``; the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.functions.timing import use_utc
from loomtrail.model import ColumnBinding, PiiClass, Retention, SemanticContract
from loomtrail.sources.readers import number_parquet_rows

KEY = b"synthetic-test-secret"
DATASET = "dirty-events"

BINDING = ColumnBinding(
    case_id="raw_case",
    activity="raw_activity",
    timestamp="raw_ts",
    event_id="raw_id",
    optional={
        "user": "raw_user",
        "department": "raw_department",
        "system": "raw_system",
        "method": "raw_method",
        "status": "raw_status",
        "duration": "raw_duration",
        "source_sequence": "raw_sequence",
    },
    version=3,
)

CONTRACT = SemanticContract(
    source_timezone="Asia/Seoul",
    pseudonymize_case_id=True,
    retention={"user": Retention.PSEUDONYMIZE, "method": Retention.KEEP},
    pii={"department": PiiClass.PII},
)


def raw_log(spark: SparkSession, folder: str) -> DataFrame:
    e = number_parquet_rows(use_utc(spark), f"{folder}/events.parquet")
    i = F.col("event_id")

    def every(n: int):
        return i % n == 0

    day = F.date_format("ts", "yyyy-MM-dd")
    clock = F.date_format("ts", "HH:mm:ss")
    return e.select(
        "source_row_number",
        F.when(every(53), None)
        .when((i % 71).isin(0, 1), F.concat(F.lit(" "), (i - i % 71).cast("string")))
        .otherwise(i.cast("string"))
        .alias("raw_id"),
        F.when(every(97), None)
        .when(every(89), F.lit("   "))
        .otherwise(F.concat(F.lit("  U"), F.col("user_id").cast("string"), F.lit(" ")))
        .alias("raw_case"),
        F.when(every(101), None).when(every(103), F.lit(" ")).otherwise(F.col("event_type")).alias("raw_activity"),
        F.when(every(79), None)
        .when(every(73), F.lit("  "))
        .when(every(83), F.lit("not-a-timestamp"))
        .when(every(31), F.concat(day, F.lit(" 00:00:00")))
        .when(i % 3 == 1, F.concat(day, F.lit("T"), clock, F.lit("+09:00")))
        .when(i % 3 == 2, F.concat(day, F.lit("T"), clock, F.lit("Z")))
        .otherwise(F.concat(day, F.lit(" "), clock))
        .alias("raw_ts"),
        F.when(every(59), F.lit("x1")).when(every(2), i.cast("string")).alias("raw_sequence"),
        F.when(every(13), F.lit("n/a"))
        .otherwise(F.round((F.col("value") - 1.0) * 1000).cast("bigint").cast("string"))
        .alias("raw_duration"),
        F.when(F.col("event_type") == "error", F.lit("FAILED")).otherwise(F.lit(" OK ")).alias("raw_status"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("raw_user"),
        F.concat(F.lit("Service."), F.col("event_type")).alias("raw_method"),
        F.when(every(7), F.lit("  ")).otherwise(F.lit("shop")).alias("raw_system"),
        F.concat(F.lit("D"), (F.col("user_id") % 3).cast("string")).alias("raw_department"),
    )


RAW = """raw AS (
  SELECT row_number() OVER () AS source_row_number,
    CASE WHEN event_id % 53 = 0 THEN NULL
         WHEN event_id % 71 IN (0, 1) THEN ' ' || CAST(event_id - event_id % 71 AS VARCHAR)
         ELSE CAST(event_id AS VARCHAR) END AS raw_id,
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN '   '
         ELSE '  U' || CAST(user_id AS VARCHAR) || ' ' END AS raw_case,
    CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN ' ' ELSE event_type END AS raw_activity,
    CASE WHEN event_id % 79 = 0 THEN NULL WHEN event_id % 73 = 0 THEN '  '
         WHEN event_id % 83 = 0 THEN 'not-a-timestamp'
         WHEN event_id % 31 = 0 THEN strftime(ts, '%Y-%m-%d 00:00:00')
         WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+09:00')
         WHEN event_id % 3 = 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
         ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw_ts,
    CASE WHEN event_id % 59 = 0 THEN 'x1' WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS raw_sequence,
    CASE WHEN event_id % 13 = 0 THEN 'n/a'
         ELSE CAST(CAST(round((value - 1.0) * 1000) AS BIGINT) AS VARCHAR) END AS raw_duration,
    CASE WHEN event_type = 'error' THEN 'FAILED' ELSE ' OK ' END AS raw_status,
    'user-' || CAST(user_id AS VARCHAR) AS raw_user, 'Service.' || event_type AS raw_method,
    CASE WHEN event_id % 7 = 0 THEN '  ' ELSE 'shop' END AS raw_system,
    'D' || CAST(user_id % 3 AS VARCHAR) AS raw_department
  FROM events)"""

# What validation must find, stated over the raw text.
_UTC = """CASE WHEN regexp_matches(trim(raw_ts), '(:[0-9]{2}[+-][0-9]{2}:[0-9]{2}|Z)$')
              THEN timezone('UTC', try_cast(raw_ts AS TIMESTAMPTZ))
              ELSE timezone('UTC', timezone('Asia/Seoul', try_cast(raw_ts AS TIMESTAMP))) END"""

CHECKED = f"""{RAW}, timed AS (SELECT *, {_UTC} AS utc, nullif(trim(raw_id), '') AS own_id FROM raw),
repeated AS (
  SELECT coalesce('e' || own_id, concat_ws('|', coalesce(trim(raw_case), '<null>'), coalesce(trim(raw_activity), '<null>'),
         coalesce(CAST(utc AS VARCHAR), '<null>'))) AS k, count(*) AS n FROM timed GROUP BY 1),
moments AS (SELECT raw_case AS m_case, utc AS m_utc, count(*) AS m FROM timed GROUP BY ALL),
flagged AS (
  SELECT timed.*, raw_case IS NULL AS null_case_id, coalesce(trim(raw_case) = '', false) AS empty_case_id,
    raw_activity IS NULL AS null_activity, coalesce(trim(raw_activity) = '', false) AS empty_activity,
    raw_ts IS NULL AS null_timestamp, coalesce(trim(raw_ts) = '', false) AS empty_timestamp,
    coalesce(trim(raw_ts) <> '', false) AND utc IS NULL AS invalid_timestamp,
    n > 1 AS duplicate_event, m AS same_timestamp_count,
    coalesce(trim(raw_case) <> '', false) AND utc IS NOT NULL AND m > 1 AS duplicate_timestamp
  FROM timed
  JOIN repeated ON k = coalesce('e' || own_id, concat_ws('|', coalesce(trim(raw_case), '<null>'),
       coalesce(trim(raw_activity), '<null>'), coalesce(CAST(utc AS VARCHAR), '<null>')))
  JOIN moments ON raw_case IS NOT DISTINCT FROM m_case AND utc IS NOT DISTINCT FROM m_utc),
checked AS (
  SELECT *, NOT (null_case_id OR empty_case_id OR null_activity OR empty_activity OR null_timestamp
                 OR empty_timestamp OR invalid_timestamp OR duplicate_event) AS ok FROM flagged)"""
