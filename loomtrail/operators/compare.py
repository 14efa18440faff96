"""Comparisons of two logs, trends, distributions, conformance and stored aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrail.functions.quantiles import quantiles
from loomtrail.functions.timing import ratio
from loomtrail.operators.cases import THROUGHPUT_QUANTILES, case_bounds, case_summary, overview
from loomtrail.operators.dfg import dfg_edges, dfg_nodes
from loomtrail.operators.sequence import transitions
from loomtrail.operators.variants import case_traces, variant_counts, variant_summary
from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, broadcast_checked, stage


def delta(a: DataFrame, b: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Measures of B minus measures of A per key; a key missing on one side counts as zero."""
    left = a.select(*keys, *[F.col(m).alias(f"{m}_a") for m in measures])
    right = b.select(*keys, *[F.col(m).alias(f"{m}_b") for m in measures])
    joined = left.join(right, list(keys), "full_outer")
    columns = []
    for m in measures:
        va, vb = F.coalesce(f"{m}_a", F.lit(0)), F.coalesce(f"{m}_b", F.lit(0))
        columns += [va.alias(f"{m}_a"), vb.alias(f"{m}_b"), (vb - va).alias(f"{m}_delta")]
    return joined.select(*keys, *columns)


def compare_overview(a: DataFrame, b: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Volume, throughput and rework of both sides as rows ``metric_name, value_a, value_b, delta``."""
    names = ["case_count", "event_count", "activity_count", *THROUGHPUT_QUANTILES, "rework_rate"]

    def side(log: DataFrame, value: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("double").alias(value)) for n in names])
        return overview(log, policy=policy).select(F.inline(pairs))

    return (
        side(a, "value_a")
        .join(side(b, "value_b"), "metric_name")
        .withColumn("delta", F.col("value_b") - F.col("value_a"))
    )


def compare_activities(a: DataFrame, b: DataFrame) -> DataFrame:
    return delta(dfg_nodes(a), dfg_nodes(b), ["activity"], ["event_count", "case_count", "case_share"])


def compare_edges(a: DataFrame, b: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    measures = ["transition_count", "case_count", "median_transition_ms"]
    return delta(dfg_edges(a, policy=policy), dfg_edges(b, policy=policy), ["source", "target"], measures)


def _variant_shares(log: DataFrame, policy: ScalePolicy) -> DataFrame:
    """Case count and share per variant; no quantiles."""
    counts = variant_counts(stage(case_traces(log, policy=policy), "case-traces"))
    n_cases = counts.agg(F.sum("case_count").alias("n")).scalar()
    return counts.withColumn("case_share", ratio(F.col("case_count"), n_cases))


def compare_variants(a: DataFrame, b: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    return delta(
        _variant_shares(a, policy), _variant_shares(b, policy), ["variant_hash"], ["case_count", "case_share"]
    )


def case_trend(log: DataFrame, unit: str = "day", policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Started cases and their throughput per day or hour."""
    if unit not in ("day", "hour"):
        raise ValueError("unit must be day or hour")
    started = case_bounds(log).select(
        F.date_trunc(unit, "case_start_ts").cast("timestamp_ntz").alias("period"), "throughput_ms", "event_count"
    )
    started = stage(started, "case-facts")
    counts = started.groupBy("period").agg(
        F.count("*").alias("case_count"),
        F.sum("event_count").alias("event_count"),
        F.avg("throughput_ms").alias("avg_throughput_ms"),
    )
    return counts.join(quantiles(started, ["period"], "throughput_ms", THROUGHPUT_QUANTILES, policy, staged=True), "period")


def duration_histogram(log: DataFrame, low: int, high: int, buckets: int, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Number of transitions per equal-width duration bucket (0 below, ``buckets + 1`` above)."""
    steps = transitions(log, policy).filter(F.col("target").isNotNull())
    place = F.width_bucket(
        F.col("transition_ms").cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(buckets)
    )
    return steps.groupBy(place.alias("bucket")).agg(F.count("*").alias("transition_count"))


def edge_heatmap(log: DataFrame, labels: Sequence[str], policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Transition counts as a matrix over the given labels."""
    steps = transitions(log, policy).filter(F.col("target").isNotNull() & F.col("source").isin(*labels))
    counts = steps.groupBy("source", "target").agg(F.count("*").alias("n"))
    return (
        counts.groupBy("source")
        .pivot("target", list(labels))
        .agg(F.sum("n"))
        .na.fill(0, list(labels))
    )


def conformance_edges(log: DataFrame, allowed: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Transitions per edge with ``allowed``: whether a reference model lists the edge."""
    counts = (
        transitions(log, policy)
        .filter(F.col("target").isNotNull())
        .groupBy("source", "target")
        .agg(F.count("*").alias("transition_count"), F.count_distinct("case_id").alias("case_count"))
    )
    marked = allowed.select("source", "target", F.lit(True).alias("_ok"))
    return (
        counts.join(broadcast_checked(marked, policy), ["source", "target"], "left")
        .withColumn("allowed", F.col("_ok").isNotNull())
        .drop("_ok")
    )


def conformance_summary(edges: DataFrame) -> DataFrame:
    fitting = F.coalesce(F.sum(F.when(F.col("allowed"), F.col("transition_count"))), F.lit(0))
    every = F.coalesce(F.sum("transition_count"), F.lit(0))
    return edges.agg(
        every.alias("transition_count"),
        fitting.alias("allowed_count"),
        F.count_if(~F.col("allowed")).alias("deviating_edges"),
        ratio(fitting, every).alias("fitness"),
    )


def case_fitness(log: DataFrame, allowed: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Share of allowed transitions per case; 1.0 for a case without transitions."""
    steps = transitions(log, policy).select("case_id", "source", "target")
    per_case = steps.groupBy("case_id", "source", "target").agg(F.count("*").alias("n"))
    marked = allowed.select("source", "target", F.lit(True).alias("_ok"))
    joined = per_case.join(broadcast_checked(marked, policy), ["source", "target"], "left")
    real = F.col("target").isNotNull()
    every = F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0))
    good = F.coalesce(F.sum(F.when(real & F.col("_ok"), F.col("n"))), F.lit(0))
    return joined.groupBy("case_id").agg(
        every.alias("transition_count"),
        good.alias("allowed_count"),
        F.when(every == 0, 1.0).otherwise(good.cast("double") / F.nullif(every, F.lit(0))).alias("fitness"),
    )


def activity_aggregate(log: DataFrame, signature: str, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Stored form of activity figures under a filter signature."""
    per_case = log.groupBy("activity", "case_id").agg(F.count("*").alias("n"))
    counts = per_case.groupBy("activity").agg(
        F.sum("n").alias("event_count"),
        F.count("*").alias("case_count"),
        F.count_if(F.col("n") >= 2).alias("rework_case_count"),
    )
    timed = log.filter(F.col("duration_ms").isNotNull())
    spread = quantiles(
        timed, ["activity"], "duration_ms", {"median_duration_ms": 0.5, "p90_duration_ms": 0.9}, policy
    )
    return counts.join(spread, "activity", "left").withColumn("filter_signature", F.lit(signature))


def edge_aggregate(log: DataFrame, signature: str, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    return dfg_edges(log, policy=policy).select(
        F.lit(signature).alias("filter_signature"),
        F.col("source").alias("from_activity"),
        F.col("target").alias("to_activity"),
        "transition_count",
        "case_count",
        F.col("median_transition_ms").alias("median_wait_ms"),
        F.col("p90_transition_ms").alias("p90_wait_ms"),
    )


def variant_aggregate(
    log: DataFrame, signature: str, failure: Column | None = None, policy: ScalePolicy = DEFAULT_POLICY
) -> DataFrame:
    return variant_summary(log, failure, policy).withColumn("filter_signature", F.lit(signature))


def case_aggregate(log: DataFrame, signature: str) -> DataFrame:
    return case_summary(log).withColumn("filter_signature", F.lit(signature))


def daily_aggregate(log: DataFrame, signature: str, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    return case_trend(log, "day", policy).withColumn("filter_signature", F.lit(signature))
