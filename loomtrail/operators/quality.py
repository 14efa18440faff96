"""Quality figures of validated rows, gates and long-format metrics."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrail.functions.quantiles import one_row, quantiles
from loomtrail.functions.text import blank_to_null, whole_number
from loomtrail.functions.timing import moment, ratio
from loomtrail.model import LARGE_CASE_EVENTS
from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, stage

CASE_SIZE_QUANTILES = {"events_per_case_median": 0.5, "events_per_case_p90": 0.9}

# Flags of validated rows that the report counts one by one, and the name of each count.
FLAG_COUNTS = {
    "null_case_id": "null_case_id",
    "empty_case_id": "empty_case_id",
    "null_activity": "null_activity",
    "empty_activity": "empty_activity",
    "null_timestamp": "null_timestamp",
    "empty_timestamp": "empty_timestamp",
    "invalid_timestamp": "invalid_timestamp",
    "duplicate_event": "duplicate_events",
    "duplicate_timestamp": "duplicate_timestamp_rows",
}


def is_ambiguous() -> Column:
    """Equal timestamps with neither a usable sequence number nor an event id to order them."""
    return (
        F.col("duplicate_timestamp")
        & whole_number(F.col("source_sequence_value")).isNull()
        & blank_to_null(F.col("event_value")).isNull()
    )


def valid_case_sizes(validated: DataFrame) -> DataFrame:
    return (
        validated.filter("is_valid")
        .groupBy(F.trim("case_value").alias("case_id"))
        .agg(F.count("*").alias("event_count"), F.bool_or(is_ambiguous()).alias("ambiguous"))
    )


def quality_report(
    validated: DataFrame,
    dataset_id: str,
    mapping_version: int,
    large_case_events: int = LARGE_CASE_EVENTS,
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """One row. Distinct counts come from per-key groupings, so no row is expanded."""
    sizes = stage(valid_case_sizes(validated).select("event_count", "ambiguous"), "case-sizes")
    spread = quantiles(sizes, [], "event_count", CASE_SIZE_QUANTILES, policy, staged=True)
    activities = validated.filter("is_valid").agg(
        F.count_distinct(F.trim("activity_value")).alias("n")
    )
    per_case = sizes.agg(
        F.struct(
            F.count("*").alias("unique_cases"),
            F.count_if(F.col("event_count") == 1).alias("single_event_cases"),
            F.count_if("ambiguous").alias("ambiguous_ordering_cases"),
            F.coalesce(F.min("event_count"), F.lit(0)).alias("events_per_case_min"),
            F.coalesce(F.max("event_count"), F.lit(0)).alias("events_per_case_max"),
            F.count_if(F.col("event_count") > large_case_events).alias("extremely_large_cases"),
        ).alias("c")
    )
    rows = validated.agg(
        F.count("*").alias("total_rows"),
        F.count_if("is_valid").alias("valid_events"),
        F.count_if(~F.col("is_valid")).alias("invalid_events"),
        *[F.count_if(flag).alias(name) for flag, name in FLAG_COUNTS.items()],
    ).withColumns({"_c": per_case.scalar(), "_q": one_row(spread, CASE_SIZE_QUANTILES)})
    report = rows.select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(mapping_version).alias("mapping_version"),
        *[c for c in rows.columns if c not in ("_c", "_q")],
        F.col("_c.*"),
        activities.scalar().alias("unique_activities"),
        *[F.coalesce(F.col(f"_q.{q}"), F.lit(0.0)).alias(q) for q in CASE_SIZE_QUANTILES],
    )
    return report.select("*", technical_outcome().alias("outcome"), semantic_outcome().alias("semantic_quality"))


def technical_outcome() -> Column:
    return (
        F.when(F.col("valid_events") == 0, "FAILED_NO_VALID_EVENTS")
        .when(F.col("invalid_events") > 0, "PASSED_WITH_QUARANTINE")
        .otherwise("PASSED")
    )


def semantic_outcome() -> Column:
    return F.when(F.col("ambiguous_ordering_cases") > 0, "WARNING_AMBIGUOUS_ORDERING").otherwise("PASSED")


def melt(row: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A wide one-row report as rows ``(keys, metric_name, metric_value)``."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("metric_value")) for m in metrics]
    )
    return row.select(*keys, F.inline(pairs))


# How a value is shown: some counts are always neutral, some are good, the others warn when not zero.
_NEUTRAL = ("total_rows", "unique_cases", "unique_activities", "single_event_cases")
_GOOD = ("valid_events",)
METRIC_VIEWS = (
    "total_rows",
    "valid_events",
    "invalid_events",
    "unique_cases",
    "unique_activities",
    "null_case_id",
    "empty_case_id",
    "null_activity",
    "empty_activity",
    "null_timestamp",
    "invalid_timestamp",
    "single_event_cases",
    "duplicate_timestamp_rows",
    "ambiguous_ordering_cases",
    "extremely_large_cases",
    "duplicate_events",
)


def metric_views(report: DataFrame) -> DataFrame:
    """Quality report as rows with a severity."""
    name, value = F.col("metric_name"), F.col("metric_value")
    severity = (
        F.when(name.isin(*_NEUTRAL), "neutral")
        .when(name.isin(*_GOOD), "good")
        .when(value > 0, "warning")
        .otherwise("good")
    )
    return melt(report, ["dataset_id"], list(METRIC_VIEWS)).withColumn("severity", severity)


def load_metrics(
    events: DataFrame,
    *,
    earliest: datetime,
    latest: datetime,
    large_case_events: int = LARGE_CASE_EVENTS,
    unmapped: Column | None = None,
    ambiguous: Column | None = None,
) -> DataFrame:
    """Per-load rates over rows that may lack a case or a time: one row, one scan plus one
    grouping by case."""
    ts = F.col("event_ts")
    outlier = (ts < moment(earliest)) | (ts >= moment(latest))
    cases = (
        events.filter(F.col("case_id").isNotNull())
        .groupBy("case_id")
        .agg(F.count("*").alias("n"))
        .agg(
            F.struct(
                F.count("*").alias("cases"),
                F.count_if(F.col("n") == 1).alias("single"),
                F.count_if(F.col("n") > large_case_events).alias("large"),
            )
        )
    )
    none = F.lit(False)
    counts = events.agg(
        F.count("*").alias("n"),
        F.count_if(ts.isNull()).alias("no_ts"),
        F.count_if(F.col("case_id").isNull()).alias("no_case"),
        F.count_if(unmapped if unmapped is not None else none).alias("unmapped"),
        F.count_if(ambiguous if ambiguous is not None else none).alias("ambiguous"),
        F.count_if(outlier).alias("outliers"),
        F.count_if(F.col("duration_ms") < 0).alias("bad_durations"),
    ).withColumn("c", cases.scalar())
    n = F.col("n")
    return counts.select(
        n.alias("total_rows"),
        ratio(F.col("no_ts"), n).alias("missing_timestamp_rate"),
        ratio(F.col("no_case"), n).alias("missing_case_rate"),
        ratio(F.col("unmapped"), n).alias("unmapped_activity_rate"),
        F.col("ambiguous").alias("ambiguous_mapping_count"),
        F.col("outliers").alias("timestamp_outlier_count"),
        F.col("bad_durations").alias("invalid_duration_count"),
        ratio(F.col("c.single"), F.col("c.cases")).alias("case_single_event_rate"),
        ratio(F.col("c.large"), F.col("c.cases")).alias("case_extreme_length_rate"),
    )


def timestamp_quality(
    flagged: DataFrame, *, earliest: datetime, latest: datetime, aware: Column
) -> DataFrame:
    """Parse failures, future and very old values, and mixing of zoned and zone-free text."""
    ts = F.col("parsed_ts")
    counts = flagged.agg(
        F.count("*").alias("total_rows"),
        F.count_if("invalid_timestamp").alias("parse_failures"),
        F.count_if(ts >= moment(latest)).alias("future_outliers"),
        F.count_if(ts < moment(earliest)).alias("old_outliers"),
        F.count_if(ts.isNotNull() & aware).alias("zoned_rows"),
        F.count_if(ts.isNotNull() & ~aware).alias("unzoned_rows"),
    )
    return counts.select(
        "*",
        ratio(F.col("parse_failures"), F.col("total_rows")).alias("parse_failure_rate"),
        ((F.col("zoned_rows") > 0) & (F.col("unzoned_rows") > 0)).alias("zone_mismatch"),
    )


def duration_quality(log: DataFrame, large_case_events: int = LARGE_CASE_EVENTS) -> DataFrame:
    """Negative durations and extreme case lengths."""
    lengths = log.groupBy("case_id").agg(F.count("*").alias("n")).agg(
        F.struct(
            F.min("n").alias("shortest_case"),
            F.max("n").alias("longest_case"),
            F.count_if(F.col("n") > large_case_events).alias("oversized_cases"),
        )
    )
    return (
        log.agg(F.count("*").alias("event_count"), F.count_if(F.col("duration_ms") < 0).alias("negative_durations"))
        .withColumn("c", lengths.scalar())
        .select("event_count", "negative_durations", "c.*")
    )


def gate(metrics: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``(metric_name, metric_value)`` rows against (warn above, fail above) limits."""
    warn = F.create_map(*[x for m, (w, _) in limits.items() for x in (F.lit(m), F.lit(float(w)))])
    fail = F.create_map(*[x for m, (_, f) in limits.items() for x in (F.lit(m), F.lit(float(f)))])
    value, name = F.col("metric_value"), F.col("metric_name")
    checked = metrics.filter(F.col("metric_name").isin(*limits))
    return checked.select(
        "*",
        fail[name].alias("threshold_value"),
        F.when(value > fail[name], "FAIL").when(value > warn[name], "WARN").otherwise("PASS").alias("status"),
    )
