"""The aggregate layer, kept up to date by batches that come in any order.

A layer holds the events it has seen (by buckets of cases) and signed counts of what its reports need: transitions by edge and
duration, cases by edge, events by activity and duration, cases by day and throughput. All of these add up, so quantiles stay exact.
A batch reads the stored events of the cases it touches, and only from the buckets these lie in; it takes back what those cases
gave before and adds what they give now, both in one pass. A late event so replaces the one transition it falls into and nothing else.
Durations belong to single events, so a batch gives its own and no stored event is asked for them.

``add_batch`` writes a batch's events and differences under a folder of its own and then commits it under the next number
(see ``sources.commits``). A batch that has been committed is not added again; one that failed is repeated.
Of two writers at once the second is told and may repeat. Equal events are events of their own, as in the log.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.functions.timing import millis_between, ratio
from loomtrail.model import ORDER_KEYS
from loomtrail.operators.running import ranked_running_total
from loomtrail.operators.sequence import SEQUENCE_COLUMNS, transitions
from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, broadcast_checked, stage
from loomtrail.sources import commits

#: Folders the events of a layer are dealt over, by a hash of the case.
BUCKETS = 256
COMMITS = "number long, batch_id string, folder string, buckets int"
MEASURES = ("n", "cases", "rework")
_KEYS = ("kind", "k1", "k2", "value")
_NOW, _BEFORE = "+", "-"
#: What the reports ask of ``state``.
EDGE_KINDS, ACTIVITY_KINDS, DAILY_KINDS = ("edge", "edge_cases"), ("activity", "duration"), ("day",)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int")


def _rows(df: DataFrame, kind: str, k1, k2=None, value=None, n=0, cases=0, rework=0) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"), F.lit(k1).cast("string").alias("k1"), F.lit(k2).cast("string").alias("k2"),
        F.lit(value).cast("long").alias("value"), *[F.lit(m).cast("long").alias(c) for m, c in zip((n, cases, rework), MEASURES)],
    )


def durations(log: DataFrame) -> DataFrame:
    """What events give to the reports by themselves, whatever case they belong to."""
    spent = log.where("duration_ms is not null").groupBy("activity", "duration_ms").agg(F.count(F.lit(1)).alias("n"))
    return _rows(spent, "duration", F.col("activity"), value=F.col("duration_ms"), n=F.col("n"))


def contributions(after: DataFrame, before: DataFrame | None = None, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """What a set of whole cases gives to the reports: ``kind, k1, k2, value`` and the measures; less what those ``before`` gave.

    Both versions of a case go through one pass as cases of their own, told apart by the first letter of their names.
    """
    versions = [df.withColumn("case_id", F.concat(F.lit(v), "case_id")) for v, df in ((_NOW, after), (_BEFORE, before)) if df is not None]
    log = versions[0] if before is None else versions[0].unionByName(versions[1])
    sign = F.when(F.col("case_id").startswith(_BEFORE), -1).otherwise(1)
    n = F.count(F.lit(1))
    steps = transitions(log, policy).where("target is not null").select("case_id", "source", "target", "transition_ms")
    edges = stage(steps.groupBy("case_id", "source", "target", "transition_ms").agg(n.alias("n")), "layer-edges")
    per_edge = edges.groupBy("source", "target", "transition_ms").agg(F.sum(F.col("n") * sign).alias("n"))
    cases_of = edges.select("case_id", "source", "target").distinct().groupBy("source", "target").agg(F.sum(sign).alias("n"))
    per_case = log.groupBy("case_id", "activity").agg(n.alias("n"))
    acts = per_case.groupBy("activity").agg(
        F.sum(F.col("n") * sign).alias("n"), F.sum(sign).alias("cases"), F.sum(F.when(F.col("n") >= 2, sign).otherwise(0)).alias("rework")
    )
    bounds = log.groupBy("case_id").agg(F.min("event_ts").alias("first"), F.max("event_ts").alias("last"), n.alias("n"))
    begun = bounds.groupBy(
        F.date_format("first", "yyyy-MM-dd").alias("day"), millis_between(F.col("first"), F.col("last")).alias("took")
    ).agg(F.sum(F.col("n") * sign).alias("n"), F.sum(sign).alias("cases"))
    parts = [
        _rows(per_edge, "edge", F.col("source"), F.col("target"), F.col("transition_ms"), F.col("n")),
        _rows(cases_of, "edge_cases", F.col("source"), F.col("target"), cases=F.col("n")),
        _rows(acts, "activity", F.col("activity"), n=F.col("n"), cases=F.col("cases"), rework=F.col("rework")),
        _rows(begun, "day", F.col("day"), value=F.col("took"), n=F.col("n"), cases=F.col("cases")),
        _rows(bounds.agg(F.coalesce(F.sum(sign), F.lit(0)).alias("n")), "total", F.lit("cases"), cases=F.col("n")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _added(rows: DataFrame) -> DataFrame:
    summed = rows.groupBy(*_KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
    return summed.where(" or ".join(f"{m} <> 0" for m in MEASURES))


def _batches(spark: SparkSession, root: str) -> DataFrame:
    return commits.committed(spark, f"{root}/commits", COMMITS)


def _folders(spark: SparkSession, root: str, kind: str) -> list[str]:
    """One folder per committed batch."""
    return [f"{root}/{kind}/batch={r['folder']}" for r in _batches(spark, root).select("folder").collect()]


def stored_events(spark: SparkSession, root: str, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """Events of all committed batches, or of some buckets of cases; None if there is none."""
    folders = _folders(spark, root, "events")
    if not folders:
        return None
    rows = spark.read.schema(f"{_EVENTS}, batch string").option("basePath", f"{root}/events").parquet(*folders).drop("batch")
    return rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))


_EVENTS = (
    "case_id string, activity string, event_ts timestamp_ntz, source_sequence long, source_event_id string, "
    "ingest_sequence long, duration_ms long, bucket int"
)


def add_batch(
    spark: SparkSession, root: str, batch_id: str, events: DataFrame, buckets: int = BUCKETS, policy: ScalePolicy = DEFAULT_POLICY
) -> bool:
    """Add a batch of events to the layer below ``root``; False if it has been added before."""
    known = _batches(spark, root)
    number, layout, again = known.agg(
        F.coalesce(F.max("number"), F.lit(0)), F.max("buckets"), F.count_if(F.col("batch_id") == batch_id)
    ).first()
    if again:
        return False
    buckets = layout or buckets
    narrow = events.select(*SEQUENCE_COLUMNS, *[c for c in ("duration_ms",) if c in events.columns])
    if "duration_ms" not in narrow.columns:
        narrow = narrow.withColumn("duration_ms", F.lit(None).cast("long"))
    fields = [f.split(" ")[0] for f in _EVENTS.split(", ")]
    batch = stage(narrow.withColumn("bucket", _bucket(buckets)).select(*fields), "layer-batch")
    touched = stage(batch.select("case_id", "bucket").distinct(), "layer-cases")
    # At most one number per bucket of the layout.
    read = [r["bucket"] for r in touched.select("bucket").distinct().collect()]
    stored = stored_events(spark, root, read)
    if stored is None:
        added = contributions(batch, policy=policy)
    else:
        before = stage(stored.join(touched, ["case_id", "bucket"], "left_semi").select(*fields), "layer-before")
        added = contributions(before.unionByName(batch), before, policy)
    added = added.unionByName(durations(batch))
    folder = f"{number + 1:06d}-{uuid.uuid4().hex}"
    by_bucket = batch.hint("rebalance", F.col("bucket"))
    by_bucket.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/events/batch={folder}")
    _added(added).write.option("compression", "zstd").parquet(f"{root}/differences/batch={folder}")
    commits.commit(spark, f"{root}/commits", number + 1, {"batch_id": batch_id, "folder": folder, "buckets": buckets})
    return True


def state(spark: SparkSession, root: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """The sums of all committed differences, or of those a report asks for."""
    folders = _folders(spark, root, "differences")
    columns = "kind string, k1 string, k2 string, value long, n long, cases long, rework long"
    rows = spark.read.schema(columns).parquet(*folders) if folders else spark.createDataFrame([], columns)
    asked = rows if kinds is None else rows.where(F.col("kind").isin(list(kinds)))
    return stage(_added(asked), "layer-state")


def counted_quantiles(rows: DataFrame, keys: list[str], value: str, n: str, wanted: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of values that stand ``n`` times each, one row per key and value.

    Ranks are running totals over all keys in order, so one key may have most of the values.
    """
    ranked = ranked_running_total(rows.select(*keys, value, n), [*[F.col(k).asc() for k in keys], F.col(value).asc()], n)
    ranked = stage(ranked.withColumn("_before", F.col("running_total") - F.col(n)), "counted-values")
    spans = ranked.groupBy(*keys).agg(F.min("_before").alias("_start"), F.sum(n).alias("_total"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    placed = ranked.join(broadcast_checked(spans.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_start", "_total")), same)
    low, high = F.col("_before") - F.col("_start"), F.col("running_total") - F.col("_start")
    picks = []
    for name, p in wanted.items():
        at = F.lit(p) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((low <= rank) & (rank < high), F.col(value))).alias(f"_{side}_{name}"))
    found = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    part = {name: F.lit(p) * (F.col("_total") - 1) for name, p in wanted.items()}
    return found.select(*keys, *[
        (F.col(f"_lo_{q}") + (part[q] - F.floor(part[q])) * (F.col(f"_hi_{q}") - F.col(f"_lo_{q}"))).alias(q) for q in wanted
    ])


def edge_report(sums: DataFrame, signature: str) -> DataFrame:
    """The columns of ``compare.edge_aggregate``, from ``state``."""
    wanted = {"median_wait_ms": 0.5, "p90_wait_ms": 0.9}
    values = sums.where("kind = 'edge'").select("k1", "k2", "value", "n")
    counts = values.groupBy("k1", "k2").agg(F.sum("n").alias("transition_count"))
    cases = sums.where("kind = 'edge_cases'").select("k1", "k2", F.col("cases").alias("case_count"))
    return counts.join(cases, ["k1", "k2"]).join(counted_quantiles(values, ["k1", "k2"], "value", "n", wanted), ["k1", "k2"]).select(
        F.lit(signature).alias("filter_signature"), F.col("k1").alias("from_activity"), F.col("k2").alias("to_activity"),
        "transition_count", "case_count", *wanted,
    )


def activity_report(sums: DataFrame, signature: str) -> DataFrame:
    """The columns of ``compare.activity_aggregate``, from ``state``."""
    wanted = {"median_duration_ms": 0.5, "p90_duration_ms": 0.9}
    counts = sums.where("kind = 'activity'").select(
        F.col("k1").alias("activity"), F.col("n").alias("event_count"), F.col("cases").alias("case_count"),
        F.col("rework").alias("rework_case_count"),
    )
    values = sums.where("kind = 'duration'").select(F.col("k1").alias("activity"), "value", "n")
    spread = counted_quantiles(values, ["activity"], "value", "n", wanted)
    return counts.join(spread, "activity", "left").withColumn("filter_signature", F.lit(signature))


def daily_report(sums: DataFrame, signature: str) -> DataFrame:
    """The columns of ``compare.daily_aggregate``, from ``state``."""
    wanted = {"median_throughput_ms": 0.5, "p90_throughput_ms": 0.9}
    days = sums.where("kind = 'day'").select(F.col("k1").cast("timestamp_ntz").alias("period"), "value", "n", "cases")
    counts = days.groupBy("period").agg(
        F.sum("cases").alias("case_count"), F.sum("n").alias("event_count"),
        ratio(F.sum(F.col("value") * F.col("cases")), F.sum("cases")).alias("avg_throughput_ms"),
    )
    spread = counted_quantiles(days.select("period", "value", "cases"), ["period"], "value", "cases", wanted)
    return counts.join(spread, "period").withColumn("filter_signature", F.lit(signature))
