"""The aggregate layer: batches in any order against the whole log."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomtrail.operators import compare, layers
from loomtrail.scale import ScalePolicy, stage
from loomtrail.sources import commits

COLUMNS = (
    "event_id string, case_id string, activity string, event_ts timestamp_ntz, source_sequence long, source_event_id string, "
    "ingest_sequence long, duration_ms long"
)


@pytest.fixture(scope="module")
def log(spark):
    """Cases over several days with equal times, one case with most events, some durations missing."""
    rng = random.Random(8)
    rows = []
    for k in range(600):
        case = "hot" if k % 2 else f"c{rng.randrange(25)}"
        at = datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(6000) // 7 * 7)
        spent = rng.choice([None, 5, 10, rng.randrange(500)])
        rows.append((f"e{k}", case, rng.choice("ABCD"), at, rng.randrange(3), f"e{k}", k, spent))
    return stage(spark.createDataFrame(rows, COLUMNS), "layer-test-log")


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(tuple(str(round(r[c], 6) if isinstance(r[c], float) else r[c]) for c in columns) for r in df.collect())


def test_ten_batches_in_any_order_equal_a_full_run(spark, log, tmp_path):
    root = str(tmp_path / "layer")
    order = list(range(10))
    random.Random(3).shuffle(order)
    part = F.pmod(F.xxhash64("event_id"), F.lit(10))
    for k in order:
        assert layers.add_batch(spark, root, f"b{k}", log.where(part == k), buckets=4, policy=ScalePolicy(max_group_rows=150))
    assert not layers.add_batch(spark, root, "b3", log.where(part == 3))
    sums = layers.state(spark, root)
    assert rows_of(layers.edge_report(sums, "s")) == rows_of(compare.edge_aggregate(log, "s"))
    assert rows_of(layers.activity_report(sums, "s")) == rows_of(compare.activity_aggregate(log, "s"))
    assert rows_of(layers.daily_report(sums, "s")) == rows_of(compare.daily_aggregate(log, "s"))
    assert layers.stored_events(spark, root).count() == 600


def test_a_batch_reads_the_buckets_of_its_cases(spark, log, tmp_path):
    root = str(tmp_path / "layer")
    layers.add_batch(spark, root, "first", log, buckets=16)
    plan = layers.stored_events(spark, root, [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_late_event_replaces_one_transition(spark, tmp_path):
    def events(*rows):
        at = datetime(2024, 1, 1)
        full = [(f"{c}{m}", c, a, at + timedelta(minutes=m), None, f"{c}{m}", m, None) for c, a, m in rows]
        return spark.createDataFrame(full, COLUMNS)

    root = str(tmp_path / "layer")
    layers.add_batch(spark, root, 1, events(("x", "A", 0), ("x", "C", 10), ("y", "A", 0), ("y", "C", 4)))
    layers.add_batch(spark, root, 2, events(("x", "B", 5)))
    last = layers._folders(spark, root, "differences")[-1:]
    paths = sorted(last + layers._folders(spark, root, "differences"))[-1]
    changed = {(r.kind, r.k1, r.k2, r.value): (r.n, r.cases) for r in spark.read.parquet(paths).collect() if r.kind == "edge"}
    assert changed == {("edge", "A", "C", 600_000): (-1, 0), ("edge", "A", "B", 300_000): (1, 0), ("edge", "B", "C", 300_000): (1, 0)}
    got = {(r.from_activity, r.to_activity): r.case_count for r in layers.edge_report(layers.state(spark, root), "s").collect()}
    assert got == {("A", "C"): 1, ("A", "B"): 1, ("B", "C"): 1}


def test_of_two_writers_one_wins(spark, log, tmp_path, monkeypatch):
    root = str(tmp_path / "layer")
    layers.add_batch(spark, root, "one", log.limit(50))
    before = layers._batches
    with monkeypatch.context() as m:
        m.setattr(layers, "_batches", lambda *a: before(*a).limit(0))
        with pytest.raises(commits.CommitConflict):
            layers.add_batch(spark, root, "two", log.limit(10))
    assert layers.stored_events(spark, root).count() == 50


def test_empty_layer(spark, tmp_path):
    sums = layers.state(spark, str(tmp_path / "none"))
    assert layers.edge_report(sums, "s").count() == layers.daily_report(sums, "s").count() == 0


def test_a_batch_orders_both_versions_of_its_cases_at_once(spark, log, tmp_path, monkeypatch):
    root, labels = str(tmp_path / "layer"), []
    monkeypatch.setattr(layers, "stage", lambda df, label: labels.append(label) or stage(df, label))
    for k in range(2):
        layers.add_batch(spark, root, f"b{k}", log.where(F.col("ingest_sequence") % 2 == k), buckets=4)
    assert labels.count("layer-edges") == 2
    sums = layers.state(spark, root, layers.ACTIVITY_KINDS)
    assert {r.kind for r in sums.select("kind").distinct().collect()} == {"activity", "duration"}
    assert rows_of(layers.activity_report(sums, "s")) == rows_of(compare.activity_aggregate(log, "s"))
