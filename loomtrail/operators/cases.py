"""Per-case facts and the figures derived from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrail.functions.quantiles import one_row, quantiles
from loomtrail.functions.timing import millis_between, ratio
from loomtrail.model import CASE_PAGE_SIZE, ORDER_KEYS
from loomtrail.operators.dfg import case_total
from loomtrail.operators.filters import in_range
from loomtrail.operators.sequence import event_order, follow, order_value
from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, stage

THROUGHPUT_QUANTILES = {"median_throughput_ms": 0.5, "p90_throughput_ms": 0.9}


def case_bounds(log: DataFrame) -> DataFrame:
    """Start, end, throughput and number of events; combined before the shuffle."""
    return (
        log.groupBy("case_id")
        .agg(
            F.min("event_ts").alias("case_start_ts"),
            F.max("event_ts").alias("case_end_ts"),
            F.count("*").alias("event_count"),
        )
        .withColumn("throughput_ms", millis_between(F.col("case_start_ts"), F.col("case_end_ts")))
    )


def activity_per_case(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id", "activity").agg(
        F.count("*").alias("activity_count"),
        F.min("event_ts").alias("first_ts"),
        F.max("event_ts").alias("last_ts"),
    )


def case_summary(log: DataFrame) -> DataFrame:
    """One row per case: bounds, throughput, events, distinct activities, rework flag.

    The inner grouping by (case, activity) keeps a very large case spread over many tasks.
    """
    return (
        activity_per_case(log)
        .groupBy("case_id")
        .agg(
            F.min("first_ts").alias("case_start_ts"),
            F.max("last_ts").alias("case_end_ts"),
            F.sum("activity_count").alias("event_count"),
            F.count("*").alias("distinct_activity_count"),
            (F.max("activity_count") >= 2).alias("has_rework"),
        )
        .withColumn("throughput_ms", millis_between(F.col("case_start_ts"), F.col("case_end_ts")))
    )


def rework_cases(log: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """Cases that repeat an activity. ``exempt(activity)`` lists repeats that are normal."""
    repeated = (
        log.groupBy("case_id", "activity")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= 2)
    )
    if exempt is not None:
        repeated = repeated.join(exempt.select("activity"), "activity", "left_anti")
    return repeated.select("case_id").distinct()


def rework_rate(log: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    return (
        rework_cases(log, exempt)
        .agg(F.count("*").alias("rework_cases"))
        .withColumn("total_cases", case_total(log))
        .withColumn("rework_rate", ratio(F.col("rework_cases"), F.col("total_cases")))
    )


def rework_by_activity(log: DataFrame) -> DataFrame:
    return (
        log.groupBy("case_id", "activity")
        .agg(F.count("*").alias("n"))
        .groupBy("activity")
        .agg(
            F.count_if(F.col("n") >= 2).alias("rework_case_count"),
            F.count("*").alias("cases_with_activity"),
        )
        .withColumn(
            "rework_case_rate",
            F.col("rework_case_count").cast("double") / F.nullif(F.col("cases_with_activity"), F.lit(0)),
        )
        .orderBy(F.desc_nulls_last("rework_case_rate"), F.desc("rework_case_count"), "activity")
    )


def overview(
    log: DataFrame,
    failure: Column | None = None,
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """One row: cases, events, activities, median and p90 throughput, rework rate
    (and failure rate of events when ``failure`` is given). Quantiles are NULL on an empty log."""
    per_case = stage(case_summary(log).select("event_count", "throughput_ms", "has_rework"), "case-facts")
    figures = per_case.agg(
        F.count("*").alias("case_count"),
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("event_count"),
        F.count_if("has_rework").alias("_rework"),
    )
    spread = quantiles(per_case, [], "throughput_ms", THROUGHPUT_QUANTILES, policy, staged=True)
    n_activities = log.agg(F.count_distinct("activity").alias("n")).scalar()
    row = figures.withColumn("_q", one_row(spread, THROUGHPUT_QUANTILES)).select(
        "case_count",
        "event_count",
        n_activities.alias("activity_count"),
        *[F.col(f"_q.{q}") for q in THROUGHPUT_QUANTILES],
        ratio(F.col("_rework"), F.col("case_count")).alias("rework_rate"),
    )
    if failure is not None:
        failed = log.agg(F.count_if(failure).alias("n")).scalar()
        row = row.withColumn("failure_rate", ratio(failed, F.col("event_count")))
    return row


def throughput_statistics(log: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    per_case = stage(case_bounds(log).select("throughput_ms"), "case-facts")
    wanted = {
        "median_throughput_ms": 0.5,
        "p75_throughput_ms": 0.75,
        "p90_throughput_ms": 0.9,
        "p95_throughput_ms": 0.95,
    }
    spread = quantiles(per_case, [], "throughput_ms", wanted, policy, staged=True)
    row = per_case.agg(
        F.avg("throughput_ms").alias("avg_throughput_ms"),
        F.max("throughput_ms").alias("max_throughput_ms"),
    )
    return row.withColumn("_q", one_row(spread, wanted)).select(*row.columns, "_q.*")


def slowest_cases(log: DataFrame, limit: int) -> DataFrame:
    return case_bounds(log).orderBy(F.desc("throughput_ms"), "case_id").limit(limit)


def case_ends(log: DataFrame) -> DataFrame:
    """First and last activity of every case; a plain aggregate, so no case is sorted."""
    return log.groupBy("case_id").agg(
        F.min_by("activity", order_value()).alias("start_activity"),
        F.max_by("activity", order_value()).alias("end_activity"),
    )


def _ranked_labels(cases: DataFrame, column: str) -> DataFrame:
    return (
        cases.groupBy(F.col(column).alias("activity"))
        .agg(F.count("*").alias("case_count"))
        .orderBy(F.desc("case_count"), "activity")
    )


def start_activities(log: DataFrame) -> DataFrame:
    firsts = log.groupBy("case_id").agg(F.min_by("activity", order_value()).alias("label"))
    return _ranked_labels(firsts, "label")


def end_activities(log: DataFrame) -> DataFrame:
    lasts = log.groupBy("case_id").agg(F.max_by("activity", order_value()).alias("label"))
    return _ranked_labels(lasts, "label")


def case_timeline(log: DataFrame, case_id: str, limit: int = CASE_PAGE_SIZE) -> DataFrame:
    """The first ``limit`` events of one case in order, with what follows each of them."""
    bounded = (
        log.filter(F.col("case_id") == case_id)
        .select("event_id", "case_id", "activity", *ORDER_KEYS)
        .orderBy(*event_order())
        .limit(limit + 1)
    )
    along = W.partitionBy("case_id").orderBy(*event_order())
    return (
        bounded.withColumn("event_position", F.row_number().over(along).cast("bigint"))
        .withColumn("next_activity", F.lead("activity").over(along))
        .withColumn("next_event_ts", F.lead("event_ts").over(along))
        .filter(F.col("event_position") <= limit)
        .select("event_id", "case_id", "activity", "event_ts", "event_position", "next_activity", "next_event_ts")
    )


def search_cases(
    log: DataFrame,
    *,
    date_from: datetime | None = None,
    date_to: datetime | None = None,
    activity: str | None = None,
    variant_cases: DataFrame | None = None,
    after_case_id: str | None = None,
    page_size: int = CASE_PAGE_SIZE,
) -> DataFrame:
    """One page of case summaries in case-id order. The next page starts after the last id.

    The ids of the page are found first; only their events are summed up.
    """
    if after_case_id is not None:
        log = log.filter(F.col("case_id") > after_case_id)
    ids = log if activity is None else log.filter(F.col("activity") == activity)
    ids = ids.select("case_id").distinct()
    if date_from is not None or date_to is not None:
        active = in_range(log, date_from, date_to).select("case_id").distinct()
        ids = ids.join(active, "case_id", "left_semi")
    if variant_cases is not None:
        ids = ids.join(variant_cases.select("case_id"), "case_id", "left_semi")
    page = F.broadcast(ids.orderBy("case_id").limit(page_size))  # page_size rows
    return case_bounds(log.join(page, "case_id", "left_semi")).orderBy("case_id")


def failure_rate_by_activity(log: DataFrame, failure: Column) -> DataFrame:
    return (
        log.groupBy("activity")
        .agg(F.count("*").alias("event_count"), F.count_if(failure).alias("failed_count"))
        .withColumn("failure_rate", ratio(F.col("failed_count"), F.col("event_count")))
        .orderBy(F.desc("failure_rate"), "activity")
    )


def after_failure(log: DataFrame, failure: Column, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Which activity directly follows a failed event, and how often."""
    needed = log.select("case_id", "activity", *ORDER_KEYS, failure.alias("_failed"))
    return (
        follow(needed, policy)
        .filter(F.col("_failed") & F.col("next_activity").isNotNull())
        .groupBy(F.col("activity").alias("failed_activity"), "next_activity")
        .agg(F.count("*").alias("transition_count"), F.count_distinct("case_id").alias("case_count"))
        .orderBy(F.desc("transition_count"), "failed_activity", "next_activity")
    )


def throughput_by_outcome(log: DataFrame, failure: Column, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Cases, mean, median and p90 throughput of failed and of successful cases."""
    cases = (
        log.groupBy("case_id")
        .agg(
            F.min("event_ts").alias("a"),
            F.max("event_ts").alias("b"),
            F.coalesce(F.bool_or(failure), F.lit(False)).alias("failed"),
        )
        .select("failed", millis_between(F.col("a"), F.col("b")).alias("throughput_ms"))
    )
    cases = stage(cases, "case-facts")
    means = cases.groupBy("failed").agg(
        F.count("*").alias("case_count"), F.avg("throughput_ms").alias("avg_throughput_ms")
    )
    return means.join(quantiles(cases, ["failed"], "throughput_ms", THROUGHPUT_QUANTILES, policy, staged=True), "failed")


def result_codes(log: DataFrame) -> DataFrame:
    n = log.agg(F.count("*").alias("n")).scalar()
    return (
        log.groupBy("result_code")
        .agg(F.count("*").alias("event_count"), F.count_distinct("case_id").alias("case_count"))
        .withColumn("event_share", ratio(F.col("event_count"), n))
        .orderBy(F.desc("event_count"), "result_code")
    )
