"""Variants: cases with the same ordered activity sequence.

Cases are grouped by a hash of the sequence, never by the sequence itself. The hash of a long
sequence is built from chunk hashes at fixed positions, so it does not depend on how a large case
was cut, and no task ever holds more than one chunk of a large case.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrail.functions.quantiles import quantiles
from loomtrail.functions.timing import millis_between, ratio
from loomtrail.model import MAX_VARIANTS, ORDER_KEYS
from loomtrail.operators.cases import THROUGHPUT_QUANTILES, case_summary
from loomtrail.operators.running import ranked_running_total
from loomtrail.operators.sequence import CaseSplit, follow, follow_split, order_value, split_cases
from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, broadcast_checked, stage

CHUNK = 4096
GATHERED_CASE_ROWS = 200_000  # largest case that is gathered into one array
_UNIT = "\x1f"
_MISSING = "\x00\x1e"
ARROW = " > "


def _digest(parts: Column) -> Column:
    """A missing activity is a step of its own: it is written as a sign that no text contains."""
    return F.sha2(F.array_join(parts, _UNIT, _MISSING), 256)


def _combine(hashes: Column) -> Column:
    return F.when(F.size(hashes) == 1, F.element_at(hashes, 1)).otherwise(_digest(hashes))


def _chunks(items: Column) -> Column:
    """Cut an array into consecutive arrays of at most CHUNK elements."""
    last = F.floor((F.size(items) - 1) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * CHUNK + 1, CHUNK))


def trace_hash(trace: Column) -> Column:
    """Three-level hash of an activity array; equals the plain hash up to CHUNK activities."""
    level1 = F.transform(_chunks(trace), _digest)
    level2 = F.transform(_chunks(level1), _combine)
    return _combine(level2)


def _sorted_activities() -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order_value().alias("o"), F.col("activity"))))
    return F.transform(rows, lambda r: r["activity"])


def _gathered_traces(log: DataFrame, failure: Column) -> DataFrame:
    """Traces of cases that fit one task."""
    return (
        log.groupBy("case_id")
        .agg(
            F.min("event_ts").alias("_start"),
            F.max("event_ts").alias("_end"),
            F.count("*").alias("event_count"),
            F.coalesce(F.bool_or(failure), F.lit(False)).alias("has_failure"),
            _sorted_activities().alias("trace"),
        )
        .select(
            "case_id",
            trace_hash(F.col("trace")).alias("variant_hash"),
            millis_between(F.col("_start"), F.col("_end")).alias("throughput_ms"),
            "event_count",
            (F.size(F.array_distinct("trace")) < F.size("trace")).alias("has_rework"),
            "has_failure",
            "trace",
        )
    )


def _chunked_hashes(pieces: CaseSplit, policy: ScalePolicy) -> DataFrame:
    """Hashes of large cases from their event positions, one bounded chunk at a time."""

    def level(df: DataFrame, place: str, item: str, digest) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(place, item)))
        return (
            df.groupBy("case_id", F.floor(F.col(place) / CHUNK).alias("chunk"))
            .agg(rows.alias("_rows"))
            .select(
                "case_id",
                F.col("chunk").alias("place"),
                digest(F.transform("_rows", lambda r: r[item])).alias("hash"),
            )
        )

    placed = follow_split(pieces, policy, position=True).select(
        "case_id", (F.col("event_position") - 1).alias("place"), "activity"
    )
    level1 = level(placed, "place", "activity", _digest)
    level2 = level(level1, "place", "hash", _combine)
    top = F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda r: r["hash"])
    return level2.groupBy("case_id").agg(top.alias("_top")).select(
        "case_id", _combine(F.col("_top")).alias("variant_hash")
    )


def case_traces(
    log: DataFrame, failure: Column | None = None, policy: ScalePolicy = DEFAULT_POLICY
) -> DataFrame:
    """One row per case: ``variant_hash, throughput_ms, event_count, has_rework, has_failure``."""
    failed = F.lit(False) if failure is None else failure
    log = log.select("case_id", "activity", *ORDER_KEYS, failed.alias("_failed"))
    failed = F.col("_failed")
    bound = min(policy.max_group_rows, GATHERED_CASE_ROWS)
    split = split_cases(log, replace(policy, max_group_rows=bound))
    gathered = _gathered_traces(split.whole, failed).drop("trace")
    if split.pieces is None:
        return gathered
    large = split.pieces.drop("piece")
    facts = case_summary(large).select("case_id", "throughput_ms", "event_count", "has_rework")
    outcome = large.groupBy("case_id").agg(F.coalesce(F.bool_or(failed), F.lit(False)).alias("has_failure"))
    # The pieces as they are cut: no case of them is gathered.
    none_whole = large.filter(F.lit(False))
    hashed = _chunked_hashes(CaseSplit(none_whole, split.pieces), replace(policy, max_group_rows=bound))
    return gathered.unionByName(hashed.join(facts, "case_id").join(outcome, "case_id"))


def case_sequences(log: DataFrame, arrow: str = ARROW) -> DataFrame:
    """Sequence text per case. For reports on few cases: the text of a case is one value."""
    return (
        log.groupBy("case_id")
        .agg(_sorted_activities().alias("trace"))
        .select("case_id", F.array_join("trace", arrow).alias("variant_sequence"))
    )


def variant_counts(traces: DataFrame) -> DataFrame:
    return traces.groupBy("variant_hash").agg(
        F.count("*").alias("case_count"), F.min("case_id").alias("representative_case_id")
    )


def variants_top(log: DataFrame, limit: int = MAX_VARIANTS, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """The most common variants with their text, read back from one representative case each."""
    top = (
        variant_counts(case_traces(log, policy=policy))
        .orderBy(F.desc("case_count"), "variant_hash")
        .limit(limit)
    )
    # The limit bounds this side.
    chosen = broadcast_checked(top.select(F.col("representative_case_id").alias("case_id")), policy)
    texts = case_sequences(log.join(chosen, "case_id", "left_semi"))
    return (
        top.withColumnRenamed("representative_case_id", "case_id")
        .join(texts, "case_id")
        .select("variant_hash", "variant_sequence", "case_count")
        .orderBy(F.desc("case_count"), "variant_hash")
    )


def variant_steps(log: DataFrame, limit: int = MAX_VARIANTS, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """The most common variants in long form, one row per step; no size limit on a sequence."""
    top = (
        variant_counts(case_traces(log, policy=policy))
        .orderBy(F.desc("case_count"), "variant_hash")
        .limit(limit)
    )
    chosen = broadcast_checked(
        top.select("variant_hash", F.col("representative_case_id").alias("case_id")), policy
    )
    steps = follow(log.join(chosen, "case_id", "left_semi"), policy, position=True)
    return steps.join(chosen, "case_id").select(
        "variant_hash", F.col("event_position").alias("step"), "activity"
    )


def variant_summary(
    log: DataFrame, failure: Column | None = None, policy: ScalePolicy = DEFAULT_POLICY
) -> DataFrame:
    """All variants with counts, share, throughput quantiles, mean length, rework and failure rate."""
    traces = stage(case_traces(log, failure, policy), "case-traces")
    measures = [
        F.count("*").alias("case_count"),
        F.min("case_id").alias("representative_case_id"),
        F.avg("event_count").alias("avg_event_count"),
        F.avg(F.col("has_rework").cast("int")).alias("rework_rate"),
        F.avg(F.col("has_failure").cast("int")).alias("failure_rate"),
    ]
    spread = quantiles(traces, ["variant_hash"], "throughput_ms", THROUGHPUT_QUANTILES, policy, staged=True)
    grouped = traces.groupBy("variant_hash").agg(*measures).join(spread, "variant_hash")
    n_cases = traces.agg(F.count("*").alias("n")).scalar()
    return grouped.withColumn("case_share", ratio(F.col("case_count"), n_cases))


def ranked_variants(
    log: DataFrame,
    limit: int = MAX_VARIANTS,
    failure: Column | None = None,
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Top variants of ``variant_summary`` with ``rank``; the limit bounds the ranking window."""
    top = variant_summary(log, failure, policy).orderBy(F.desc("case_count"), "variant_hash").limit(limit)
    along = W.orderBy(F.desc("case_count"), "variant_hash")
    return top.withColumn("rank", F.row_number().over(along).cast("bigint"))


def variant_coverage(log: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Every variant with rank, share and cumulative share of cases."""
    counts = variant_counts(case_traces(log, policy=policy)).select("variant_hash", "case_count")
    n_cases = log.agg(F.count_distinct("case_id").alias("n")).scalar()
    return (
        ranked_running_total(counts, [F.desc("case_count"), F.col("variant_hash").asc()], "case_count", policy)
        .withColumn("case_share", ratio(F.col("case_count"), n_cases))
        .withColumn("cumulative_share", ratio(F.col("running_total"), n_cases))
        .drop("running_total")
    )


def variant_concentration(log: DataFrame, coverage: float, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """How many of the ranked variants cover the given share of cases."""
    ranked = variant_coverage(log, policy)
    return ranked.agg(
        F.count("*").alias("variant_count"),
        F.min(F.when(F.col("cumulative_share") >= coverage, F.col("rank"))).alias("variants_for_coverage"),
        F.max(F.when(F.col("rank") == 1, F.col("case_share"))).alias("top_variant_share"),
    )


def cases_of_variants(log: DataFrame, hashes: list[str], policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    return case_traces(log, policy=policy).filter(F.col("variant_hash").isin(*hashes)).select("case_id")


def filter_variants(log: DataFrame, variants: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """All events of the cases whose variant is in ``variants(variant_hash)``."""
    wanted = broadcast_checked(variants.select("variant_hash"), policy)
    cases = case_traces(log, policy=policy).join(wanted, "variant_hash", "left_semi").select("case_id")
    return log.join(cases, "case_id", "left_semi")


def variants_by_outcome(
    log: DataFrame, failure: Column, limit: int | None = None, policy: ScalePolicy = DEFAULT_POLICY
) -> DataFrame:
    """Case counts per variant, failed against successful, most frequent first; all of them by default."""
    counted = (
        case_traces(log, failure, policy)
        .groupBy("variant_hash")
        .agg(
            F.count_if("has_failure").alias("failed_cases"),
            F.count_if(~F.col("has_failure")).alias("successful_cases"),
        )
        .orderBy(F.desc(F.col("failed_cases") + F.col("successful_cases")), "variant_hash")
    )
    return counted if limit is None else counted.limit(limit)
