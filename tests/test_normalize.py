"""Raw rows to canonical log: damage, time zones, pseudonyms, retention, publication."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from conftest import GOLDEN, RAW_COLUMNS
from loomtrail.functions.privacy import hmac_token, ip_prefix
from loomtrail.functions.timestamps import (
    check_format, check_timezone, is_aware, parse_local, parse_utc, spark_pattern,
)
from loomtrail.model import CANONICAL_SCHEMA, ColumnBinding, PiiClass, Retention, SemanticContract
from loomtrail.operators import dfg
from loomtrail.operators import normalize as norm
from loomtrail.scale import ScalePolicy
from loomtrail.sources import readers, writers

KEY = b"synthetic-test-secret"
BINDING = ColumnBinding(
    "case_id", "activity", "event_ts", "event_id", optional={"source_sequence": "source_sequence"}
)
INVALID = [
    ("I001", "CASE-101", "A", "2026-02-01 09:00:00", "1"),
    ("I002", "CASE-101", "B", "2026-02-01 09:01:00", "2"),
    ("I003", None, "A", "2026-02-01 10:00:00", "1"),
    ("I004", " ", "A", "2026-02-01 10:01:00", "1"),
    ("I005", "CASE-102", None, "2026-02-01 10:02:00", "1"),
    ("I006", "CASE-103", " ", "2026-02-01 10:03:00", "1"),
    ("I007", "CASE-104", "A", "not-a-timestamp", "1"),
    ("I008", "CASE-105", "A", "2026-02-01 11:00:00", "1"),
    ("I008", "CASE-105", "A", "2026-02-01 11:00:00", "1"),
]
POLICIES = [ScalePolicy(), ScalePolicy(max_group_rows=2)]


def raw(spark, rows, columns=RAW_COLUMNS):
    numbered = [(i, *r) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(numbered, "source_row_number long, " + columns)


def token(text):
    return hmac.new(KEY, text.encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize("policy", POLICIES, ids=lambda p: str(p.max_group_rows))
def test_damaged_rows(spark, policy):
    log = norm.normalize(raw(spark, INVALID), BINDING, SemanticContract(), "ds", policy=policy)
    q = log.quality.first().asDict()
    assert (q["total_rows"], q["valid_events"], q["invalid_events"]) == (9, 2, 7)
    for name in ("null_case_id", "empty_case_id", "null_activity", "empty_activity", "invalid_timestamp"):
        assert q[name] == 1, name
    assert q["duplicate_events"] == 2 and q["outcome"] == "PASSED_WITH_QUARANTINE"
    rejected = {r.source_row_number: r.failure_code for r in log.quarantine.collect()}
    assert rejected[7] == "INVALID_TIMESTAMP" and rejected[8] == rejected[9] == "DUPLICATE_EVENT"
    assert set(log.quarantine.columns) == {
        "source_row_number", "failure_code", "failure_reason", "dataset_id", "mapping_version",
    }
    assert log.events.count() + log.quarantine.count() == 9


def test_schema_and_graph_of_clean_rows(spark):
    rows = [(e, c, a, t, str(s)) for e, c, a, t, s in GOLDEN]
    log = norm.normalize(raw(spark, rows), BINDING, SemanticContract(), "ds")
    assert [(f.name, f.dataType) for f in log.events.schema] == [(f.name, f.dataType) for f in CANONICAL_SCHEMA]
    q = log.quality.first()
    assert (q.valid_events, q.invalid_events, q.single_event_cases, q.outcome) == (10, 0, 0, "PASSED")
    edges = dfg.dfg_edges(log.events).collect()
    assert len(edges) == 5 and edges[0].transition_count == 2


def test_nothing_valid(spark):
    log = norm.normalize(raw(spark, [("1", None, "A", "2026-01-01", "1")]), BINDING, SemanticContract(), "ds")
    q = log.quality.first()
    assert q.outcome == "FAILED_NO_VALID_EVENTS" and q.events_per_case_median == 0.0


def test_blank_timestamp_is_rejected(spark):
    log = norm.normalize(raw(spark, [("1", "C", "A", "   ", "1")]), BINDING, SemanticContract(), "ds")
    assert [r.failure_code for r in log.quarantine.collect()] == ["EMPTY_TIMESTAMP"]


def test_source_zone_and_pseudonyms(spark):
    rows = [("E1", "C1", "method_a", "2026-09-01 10:00:00", "1")]
    contract = SemanticContract(
        source_timezone="Asia/Seoul", pseudonymize_case_id=True, retention={"event_id": Retention.PSEUDONYMIZE}
    )
    row = norm.normalize(raw(spark, rows), BINDING, contract, "ds", KEY).events.first()
    assert str(row.event_ts) == "2026-09-01 01:00:00"
    assert row.case_id == token("C1")
    assert row.event_id == row.source_event_id == token("E1")


def test_dropped_event_id(spark):
    contract = SemanticContract(pii={"event_id": PiiClass.PII})
    rows = [("E1", "C1", "A", "2026-09-01 10:00:00", "1")]
    row = norm.normalize(raw(spark, rows), BINDING, contract, "ds").events.first()
    assert row.source_event_id is None
    assert row.event_id == hashlib.sha256(b"ds:1").hexdigest()


def test_embedded_zone_wins(spark):
    rows = [("E1", "C1", "A", "2026-09-01T10:30:00+09:00", "1")]
    row = norm.normalize(raw(spark, rows), BINDING, SemanticContract("America/New_York"), "ds").events.first()
    assert str(row.event_ts) == "2026-09-01 01:30:00"


def test_ambiguous_order(spark):
    rows = [("C1", "A", "2026-09-01 10:00:00"), ("C1", "B", "2026-09-01 10:00:00")]
    data = raw(spark, rows, "case_id string, activity string, event_ts string")
    q = norm.normalize(data, ColumnBinding("case_id", "activity", "event_ts"), SemanticContract(), "ds").quality.first()
    assert (q.duplicate_timestamp_rows, q.ambiguous_ordering_cases) == (2, 1)
    assert (q.outcome, q.semantic_quality) == ("PASSED", "WARNING_AMBIGUOUS_ORDERING")


def test_long_keys_and_unicode_tokens(spark):
    key = b"k" * 80
    text = "Prüfung-접수"
    got = spark.range(1).select(hmac_token(F.lit(text), key)).first()[0]
    assert got == hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    assert spark.range(1).select(ip_prefix(F.lit("10.1.2.3"))).first()[0] == "10.1.2.0"


def test_binding_and_contract_checks():
    columns = ["a", "b", "c"]
    ColumnBinding("a", "b", "c").check(columns)
    for bad in (
        ColumnBinding("a", "a", "c"),
        ColumnBinding("a", "b", "x"),
        ColumnBinding("a", "b", "c", optional={"shoe_size": "a"}),
    ):
        with pytest.raises(ValueError):
            bad.check(columns)
    for bad in (
        SemanticContract(retention={"duration": Retention.PSEUDONYMIZE}),
        SemanticContract(retention={"nope": Retention.KEEP}),
        SemanticContract(ordering=("event_ts", "source_row_number", "event_id", "source_sequence")),
    ):
        with pytest.raises(ValueError):
            bad.check()


def test_key_is_required(spark):
    data = raw(spark, [("E1", "C1", "A", "2026-09-01 10:00:00", "1")])
    with pytest.raises(ValueError):
        norm.normalize(data, BINDING, SemanticContract(pseudonymize_case_id=True), "ds")


def test_timestamp_texts(spark):
    texts = {
        "2026": None,
        "2026/09/01 10:00:00": "2026-09-01 10:00:00",
        "2026-09-01": "2026-09-01 00:00:00",
        "infinity": None,
        "01-09-2026": None,
        "2026-09-01T10:00:00Z": "2026-09-01 10:00:00",
        "2026-09-01 10:00:00 Asia/Seoul": "2026-09-01 01:00:00",
        "2026-09-01 10:00:00+0900": "2026-09-01 01:00:00",
        "2026-13-01": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.u and str(r.u) for r in df.select("t", parse_utc(F.col("t"), "UTC").alias("u")).collect()}
    assert got == texts
    aware = {r.t: r.a for r in df.select("t", is_aware(F.col("t")).alias("a")).collect()}
    assert not aware["01-09-2026"] and aware["2026-09-01 10:00:00+0900"]


def test_gap_in_local_time(spark):
    df = spark.createDataFrame([("2026-03-08 02:30:00",)], "t string")
    assert str(df.select(parse_utc(F.col("t"), "America/New_York")).first()[0]) == "2026-03-08 07:30:00"


def test_formats(spark):
    assert spark_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-M-d'T'H:m:s"
    assert spark_pattern("%Y%m%d") == "yyyyMMdd"
    rows = [("01.09.2026 7:05", "%d.%m.%Y %H:%M"), ("20260901", "%Y%m%d"), ("01/Sep/2026", "%d/%b/%Y")]
    for text, fmt in rows:
        got = spark.createDataFrame([(text,)], "t string").select(parse_local(F.col("t"), fmt)).first()[0]
        assert str(got).startswith("2026-09-01"), (text, got)
    bad = spark.createDataFrame([("x",)], "t string").select(parse_local(F.col("t"), "%Y%m%d")).first()[0]
    assert bad is None
    check_format(spark, "%Y-%m-%d %H:%M:%S.%f")
    check_timezone(spark, "Asia/Seoul")
    with pytest.raises(ValueError):
        check_format(spark, "%Q")
    with pytest.raises(ValueError):
        check_timezone(spark, "Mars/Olympus")


def test_zoned_format(spark):
    df = spark.createDataFrame([("01/09/2026 10:30:00 +0900",)], "t string")
    got = df.select(parse_utc(F.col("t"), "UTC", "%d/%m/%Y %H:%M:%S %z")).first()[0]
    assert str(got) == "2026-09-01 01:30:00"


def test_failed_publication_keeps_the_old_version(spark, tmp_path):
    root = str(tmp_path)
    rows = [(e, c, a, t, str(s)) for e, c, a, t, s in GOLDEN]
    log = norm.normalize(raw(spark, rows), BINDING, SemanticContract(), "ds")
    writers.publish(spark, log, root, "ds", 1)
    broken = norm.NormalizedLog(
        events=log.events.withColumn("x", F.raise_error(F.lit("disk full"))),
        quarantine=log.quarantine, quality=log.quality, validated=log.validated,
    )
    with pytest.raises(Exception):
        writers.publish(spark, broken, root, "ds", 2)
    assert [r.version for r in writers.publications(spark, root, "ds").collect()] == [1]
    assert readers.normalized_source(spark, root + "/ds/events/v=1", "ds", 1).events.count() == 10
    assert writers.current_events(spark, root, "ds").count() == 10


def test_whole_numbers(spark):
    from loomtrail.functions.text import whole_number

    texts = {"7": 7, " 7 ": 7, "+5": 5, "1.6": 2, "2.5": 3, "-2.5": -3, "1e3": 1000, "x1": None, "": None, "n/a": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", whole_number(F.col("t")).alias("n")).collect()} == texts


def test_publication_is_repeated_and_has_one_winner(spark, tmp_path, monkeypatch):
    from loomtrail.sources import commits

    root = str(tmp_path)
    log = norm.normalize(raw(spark, [(e, c, a, t, str(s)) for e, c, a, t, s in GOLDEN]), BINDING, SemanticContract(), "ds")
    broken = norm.NormalizedLog(
        events=log.events.withColumn("x", F.raise_error(F.lit("disk full"))),
        quarantine=log.quarantine, quality=log.quality, validated=log.validated,
    )
    with pytest.raises(Exception):
        writers.publish(spark, broken, root, "ds", 1)
    # A crash behind the data, before the commit.
    with monkeypatch.context() as m:
        m.setattr(commits, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            writers.publish(spark, log, root, "ds", 1)
    assert writers.publications(spark, root, "ds").count() == 0
    assert writers.orphans(spark, root, "ds").count() >= 3
    writers.publish(spark, log, root, "ds", 1)
    assert writers.current_events(spark, root, "ds").count() == 10
    assert writers.orphans(spark, root, "ds").count() >= 3
    with pytest.raises(commits.CommitConflict):
        writers.publish(spark, log, root, "ds", 1)
    # Another publisher commits while this one writes.
    before = writers.publications
    with monkeypatch.context() as m:
        m.setattr(writers, "publications", lambda *a: before(*a).limit(0))
        with pytest.raises(commits.CommitConflict):
            writers.publish(spark, log, root, "ds", 1)
    assert [r.version for r in writers.publications(spark, root, "ds").collect()] == [1]
    assert not list(tmp_path.rglob("*.tmp"))
