"""Mapping sets, coverage, rules, registries and gates."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import as_log
from loomtrail.model import UnmappedPolicy
from loomtrail.operators import caserules, compare, dfg, mapping, quality, versions

SEMANTIC = [
    ("E1", "C1", "method_a", "2026-09-01 10:00:00", 1),
    ("E2", "C1", "method_b", "2026-09-01 10:00:00", 2),
    ("E3", "C1", "method_c", "2026-09-01 11:00:00", 3),
    ("E4", "C2", "method_a", "2026-09-02 09:00:00", 1),
    ("E5", "C2", "method_unknown", "2026-09-02 09:05:00", 2),
    ("E6", "C3", "method_a", "2026-09-03 09:00:00", 1),
    ("E7", "C3", "method_c", "2026-09-03 09:10:00", 2),
]
ENTRY = "source_activity string, business_activity string, enabled boolean"


@pytest.fixture()
def log(spark):
    return as_log(spark, SEMANTIC)


def entries(spark, *pairs):
    return spark.createDataFrame([(s, b, True) for s, b in pairs], ENTRY)


def test_coverage(spark, log):
    sets = entries(spark, ("method_a", "Receive"), ("method_b", "Check"), ("method_c", "Approve"))
    rows = mapping.coverage_rows(log, sets)
    s = mapping.coverage_summary(rows).first()
    assert (s.unique_source_activities, s.mapped_activities, s.business_activities, s.unmapped_event_count) == (4, 3, 4, 1)
    assert s.event_mapping_coverage == pytest.approx(6 / 7)
    assert mapping.filter_coverage(rows, "unmapped").first().source_activity == "method_unknown"
    assert [r.source_activity for r in mapping.filter_coverage(rows, "all", "APPR").collect()] == ["method_c"]


def test_grouping_of_unmapped(spark, log):
    one = entries(spark, ("method_a", "Receive"))
    grouped = mapping.business_log(log, one, UnmappedPolicy.GROUP_AS_UNMAPPED)
    assert {r.activity for r in grouped.collect()} == {"Receive", "__UNMAPPED__"}
    summary = mapping.coverage_summary(mapping.coverage_rows(log, one), UnmappedPolicy.GROUP_AS_UNMAPPED)
    assert summary.first().business_activities == 2


def test_exclusion_bridges(spark, log):
    two = entries(spark, ("method_a", "Receive"), ("method_c", "Approve"))
    edges = dfg.dfg_edges(mapping.business_log(log, two, UnmappedPolicy.EXCLUDE)).collect()
    assert [(e.source, e.target, e.transition_count) for e in edges] == [("Receive", "Approve", 2)]
    assert edges[0].case_share == pytest.approx(2 / 3)  # C2 keeps its one mapped event
    disabled = two.withColumn("enabled", F.col("source_activity") == "method_a")
    assert mapping.business_log(log, disabled, UnmappedPolicy.EXCLUDE).count() == 3


def test_sets(spark):
    old = entries(spark, ("a", "A"), ("b", "B"), ("c", "C"))
    new = entries(spark, ("a", "A"), ("b", "X"), ("d", "D"))
    change = {r.source_activity: r.change for r in mapping.compare_mapping_sets(old, new).collect()}
    assert change == {"a": "UNCHANGED", "b": "CHANGED", "c": "REMOVED", "d": "ADDED"}
    assert mapping.repeated_source_activities(entries(spark, ("a", "A"), (" a ", "B"))).first() == ("a", 2)


RULE = (
    "mapping_id string, priority int, source_system string, class_pattern string, method_pattern string,"
    " module_pattern string, activity_name string, activity_group string, valid_from timestamp_ntz,"
    " valid_to timestamp_ntz, enabled boolean"
)


def test_rules(spark):
    rules = [
        ("low", 1, None, None, "^save", None, "Save", "G", None, None, True),
        ("high", 9, "web", None, "Claim$", None, "Save claim", "G", None, datetime(2026, 2, 1), True),
        ("tie1", 5, None, "Pay", None, None, "Pay", "G", None, None, True),
        ("tie2", 5, None, None, "pay", "core", "Settle", "G", None, None, True),
        ("off", 99, None, None, ".*", None, "Never", "G", None, None, False),
    ]
    events = [
        ("1", datetime(2026, 1, 1), "web", "X", "saveClaim", "core"),
        ("2", datetime(2026, 3, 1), "web", "X", "saveClaim", "core"),
        ("3", datetime(2026, 1, 1), "app", "X", "saveClaim", None),
        ("4", datetime(2026, 1, 1), "app", "PayService", "pay", "core"),
        ("5", datetime(2026, 1, 1), "app", "PayService", "pay", None),
        ("6", datetime(2026, 1, 1), "app", None, "other", None),
    ]
    log = spark.createDataFrame(
        events, "event_id string, event_ts timestamp_ntz, source_system string, source_class string, source_method string, module string"
    )
    got = {r.event_id: (r.activity, r.mapping_status) for r in mapping.apply_activity_rules(log, spark.createDataFrame(rules, RULE)).collect()}
    assert got == {
        "1": ("Save claim", "MAPPED"), "2": ("Save", "MAPPED"), "3": ("Save", "MAPPED"),
        "4": (None, "AMBIGUOUS"), "5": ("Pay", "MAPPED"), "6": (None, "UNMAPPED"),
    }


def test_case_rules(spark):
    events = spark.createDataFrame(
        [("1", '{"claimNo": "C9"}', "u1", " "), ("2", "{}", "u2", "s2"), ("3", None, " ", None)],
        "event_id string, params string, u string, s string",
    ).withColumn("event_ts", F.lit("2026-01-01").cast("timestamp_ntz"))
    rules = [
        caserules.CaseRule("json", "json_path", ("params",), 10, "$.claimNo", hash_required=False),
        caserules.CaseRule("both", "composite", ("u", "s"), 5, hash_required=False),
        caserules.CaseRule("user", "column", ("u",), 1, hash_required=False),
    ]
    got = {r.event_id: (r.case_id, r.case_rule_id) for r in caserules.extract_case_id(events, rules).collect()}
    assert got == {"1": ("C9", "json"), "2": ("u2-s2", "both"), "3": (None, None)}
    with pytest.raises(ValueError):
        caserules.extract_case_id(events, [caserules.CaseRule("h", "column", ("u",))])
    clean = caserules.whitelist_attributes(events, "params", {"claim": "$.claimNo"})
    assert "params" not in clean.columns and clean.filter("event_id = '1'").first().claim == "C9"


def test_registry(spark):
    registry = spark.createDataFrame([("d1", 1, "a"), ("d1", 2, "b"), ("d2", 1, "c")], "dataset_id string, version int, x string")
    datasets = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "dataset_id string")
    assert dict(versions.next_versions(datasets, registry).collect()) == {"d1": 3, "d2": 2, "d3": 1}
    status = {(r.dataset_id, r.version): r.status for r in versions.with_status(registry).collect()}
    assert status == {("d1", 1): "SUPERSEDED", ("d1", 2): "ACTIVE", ("d2", 1): "ACTIVE"}
    assert {r.dataset_id: r.x for r in versions.latest(registry).collect()} == {"d1": "b", "d2": "c"}


def test_artifacts(spark):
    rows = [("d", "SOURCE", 1, 10, False), ("d", "NORMALIZED", 1, 5, False), ("d", "NORMALIZED", 2, 6, False),
            ("d", "QUARANTINE", 1, 1, True), ("d", "QUARANTINE", 2, 2, False)]
    art = versions.active_artifacts(
        spark.createDataFrame(rows, "dataset_id string, artifact_type string, version int, size_bytes long, pinned boolean")
    )
    assert [(r.artifact_type, r.version) for r in versions.removable_artifacts(art).collect()] == [("NORMALIZED", 1)]
    assert tuple(versions.storage_usage(art).first()) == ("d", 10, 6, 2, 6, 0, 24)


def test_gate_and_views(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.02), ("c", 0.0)], "metric_name string, metric_value double")
    got = {r.metric_name: r.status for r in quality.gate(rows, {m: (0.01, 0.1) for m in "abc"}).collect()}
    assert got == {"a": "FAIL", "b": "WARN", "c": "PASS"}


def test_comparison_and_conformance(spark, log):
    a, b = log.filter("case_id <> 'C3'"), log.filter("case_id <> 'C1'")
    rows = {(r.source, r.target): r.transition_count_delta for r in compare.compare_edges(a, b).collect()}
    assert rows[("method_a", "method_c")] == 1 and rows[("method_a", "method_b")] == -1
    allowed = spark.createDataFrame([("method_a", "method_b"), ("method_b", "method_c")], "source string, target string")
    s = compare.conformance_summary(compare.conformance_edges(log, allowed)).first()
    assert (s.transition_count, s.allowed_count, s.deviating_edges) == (4, 2, 2)
    fit = {r.case_id: r.fitness for r in compare.case_fitness(log, allowed).collect()}
    assert fit == {"C1": 1.0, "C2": 0.0, "C3": 0.0}


def test_entries_are_trimmed_and_unique(spark):
    log = as_log(spark, [("1", "c", "A", "2026-01-01", 1), ("2", "c", "B", "2026-01-02", 2)])
    columns = "source_activity string, business_activity string, activity_group string, enabled boolean"
    padded = spark.createDataFrame([(" A", " one ", None, True), ("B", "two", "g", True), ("B", "x", "g", False)], columns)
    assert [r.activity for r in mapping.business_log(log, padded).orderBy("event_ts").collect()] == ["one", "two"]
    assert [r.activity for r in mapping.grouped_log(log, padded, UnmappedPolicy.EXCLUDE).collect()] == ["g"]
    twice = spark.createDataFrame([("A", "one", None, True), ("A ", "two", None, True)], columns)
    with pytest.raises(ValueError):
        mapping.business_log(log, twice)


def test_mapping_sets_are_trimmed_and_checked(spark, golden):
    columns = "source_activity string, business_activity string, enabled boolean"
    old = spark.createDataFrame([(" A", "Start", True), ("B", " ", True), ("C", "End", True), ("X", "x", False)], columns)
    new = spark.createDataFrame([("A ", "Start ", True), ("B", None, True), ("C", "Close", True), ("D", "d", True)], columns)
    got = {r.source_activity: (r.old_label, r.new_label, r.change) for r in mapping.compare_mapping_sets(old, new).collect()}
    assert got == {
        "A": ("Start", "Start", "UNCHANGED"), "B": (None, None, "UNCHANGED"), "C": ("End", "Close", "CHANGED"), "D": (None, "d", "ADDED"),
    }
    twice = old.unionByName(old.where("source_activity = 'B'"))
    for broken in (lambda: mapping.compare_mapping_sets(twice, new), lambda: mapping.coverage_rows(golden, twice)):
        with pytest.raises(ValueError):
            broken()


def test_ip_networks(spark):
    from loomtrail.functions.privacy import ip_prefix

    texts = {
        "10.1.2.3": "10.1.2.0", " 192.168.0.255 ": "192.168.0.0", "2001:db8::17": "2001:db8:0::/48", "2001:DB8:a:1:2:3:4:5": "2001:db8:a::/48",
        "::1": "0:0:0::/48", "fe80::1%eth0": "fe80:0:0::/48", "::ffff:10.1.2.3": "10.1.2.0", "2001:0db8:0000::": "2001:db8:0::/48",
        "host.example": None, "1.2.3": None, "1:2:3": None, "": None, None: None, "a::b::c": None, "::": "0:0:0::/48",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", ip_prefix(F.col("t")).alias("n")).collect()} == texts


def test_rule_index_equals_brute_force(spark):
    rng = random.Random(21)
    classes = [f"{a}{b}Service" for a in ("Order", "Payment", "Claim", "Po", "Abcdefghijklmnopqrstuvwxyz") for b in ("", "Line", "Xy")]
    methods = [f"{a}{b}" for a in ("save", "load", "do") for b in ("", "All", "One", "_x")]
    days = [datetime(2026, 1, d) for d in range(1, 20)]
    tails = ["", "$", ".*", "?", "*x", "+", "|load", "{0}All", "[A-Z]", "(x)?"]

    def pattern(values):
        if rng.random() < 0.3:
            return None
        value = rng.choice(values)
        return rng.choice(["^", "^", "^", ""]) + value[: rng.randrange(1, len(value) + 1)] + rng.choice(tails)

    rules = [
        (f"r{k}", rng.choice([None, *range(30)]), rng.choice([None, None, "web"]), pattern(classes), pattern(methods),
         rng.choice([None, None, "^co", "re$"]), f"a{k % 50}", None, rng.choice([None, *days]), rng.choice([None, *days]), rng.random() < 0.9)
        for k in range(300)
    ]
    events = [
        (str(k), rng.choice([None, *days, datetime(2025, 1, 1), datetime(2027, 1, 1)]), rng.choice([None, "web", "app"]),
         rng.choice([None, "", *classes]), rng.choice([None, *methods]), rng.choice([None, "core"]))
        for k in range(1500)
    ]
    log = spark.createDataFrame(
        events, "event_id string, event_ts timestamp_ntz, source_system string, source_class string, source_method string, module string"
    )

    def wins(e):
        _, ts, system, *values = e
        hits = []
        for r in rules:
            fits = r[10] and r[1] is not None and (r[2] is None or r[2] == system)
            fits = fits and all(p is None or (v is not None and re.search(p, v)) for p, v in zip(r[3:6], values))
            begun = r[8] is None or (ts is not None and ts >= r[8])
            if fits and begun and (r[9] is None or (ts is not None and ts < r[9])):
                hits.append(r)
        top = [r for r in hits if r[1] == max(h[1] for h in hits)]
        status = "UNMAPPED" if not top else "MAPPED" if len(top) == 1 else "AMBIGUOUS"
        return (top[0][0] if len(top) == 1 else None, status)

    table = spark.createDataFrame(rules, RULE)
    got = {r.event_id: (r.mapping_id, r.mapping_status) for r in mapping.apply_activity_rules(log, table).collect()}
    assert got == {e[0]: wins(e) for e in events}
    assert {s for _, s in got.values()} == {"MAPPED", "AMBIGUOUS", "UNMAPPED"}
    none = mapping.apply_activity_rules(log, table.limit(0))
    assert [r.mapping_status for r in none.select("mapping_status").distinct().collect()] == ["UNMAPPED"]
    assert mapping.apply_activity_rules(log.limit(0), table).count() == 0


def test_ip_steps_are_computed_once(spark):
    """However often a step of the expression reads the one before it, the plan holds that one once."""
    from loomtrail.functions.privacy import ip_prefix

    shown = spark.range(1).select(ip_prefix(F.col("id").cast("string")).alias("n"))
    assert shown._jdf.queryExecution().analyzed().toString().count("%.*$") == 1
