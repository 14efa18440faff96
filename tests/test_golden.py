"""Hand-computed figures of a three-case log."""

from datetime import datetime

import pytest

from conftest import GOLDEN, as_log
from loomtrail.model import MAX_NODES, EventFilter, effective_limit
from loomtrail.operators import cases, dfg, filters, paths, variants
from loomtrail.scale import ScalePolicy

POLICIES = [ScalePolicy(), ScalePolicy(max_group_rows=2)]


def edges_of(log, **kw):
    return [tuple(r) for r in dfg.dfg_edges(log, **kw).collect()]


@pytest.mark.parametrize("policy", POLICIES, ids=lambda p: str(p.max_group_rows))
def test_edges(golden, policy):
    edges = edges_of(golden, policy=policy)
    assert [(e[0], e[1], e[2], e[3]) for e in edges] == [
        ("A", "B", 2, 2), ("B", "C", 2, 2), ("A", "D", 1, 1), ("B", "B", 1, 1), ("D", "C", 1, 1),
    ]
    assert edges[0][4] == pytest.approx(2 / 3)
    assert edges[0][5:] == pytest.approx((90_000.0, 114_000.0))


def test_nodes_and_totals(golden):
    nodes = [tuple(r) for r in dfg.dfg_nodes(golden).collect()]
    assert [n[0] for n in nodes] == ["A", "B", "C", "D"]
    assert nodes[1] == ("B", 3, 2, pytest.approx(2 / 3))
    graph = dfg.directly_follows(golden)
    assert tuple(dfg.dfg_summary(graph).first()) == (3, 10, 4, 5)


def test_bounded_graph(golden):
    graph = dfg.directly_follows(golden, max_nodes=2, max_edges=1)
    assert [r.activity for r in graph.nodes.collect()] == ["A", "B"]
    assert [(r.source, r.target) for r in graph.edges.collect()] == [("A", "B")]
    fetched = graph.fetch()
    assert [r.activity for r in fetched["nodes"]] == ["A", "B"] and len(fetched["edges"]) == 1


def test_limits():
    assert effective_limit(None, MAX_NODES) == 100
    assert effective_limit(5000, MAX_NODES) == 100
    assert effective_limit(7, MAX_NODES) == 7
    with pytest.raises(ValueError):
        effective_limit(0, MAX_NODES)


def test_equal_timestamps_follow_the_sequence(spark):
    log = as_log(spark, [("2", "T", "Y", "2026-01-02 09:00:00", 2), ("1", "T", "X", "2026-01-02 09:00:00", 1)])
    for policy in POLICIES:
        assert [(e[0], e[1]) for e in edges_of(log, policy=policy)] == [("X", "Y")]


def test_missing_order_keys_come_last(spark):
    rows = [("b", "T", "Y", "2026-01-02 09:00:00", None), ("a", "T", "X", "2026-01-02 09:00:00", 9)]
    log = as_log(spark, rows)
    for policy in [POLICIES[0], ScalePolicy(max_group_rows=1)]:
        assert [(e[0], e[1]) for e in edges_of(log, policy=policy)] == [("X", "Y")]
    assert cases.case_ends(log).first()["end_activity"] == "Y"


@pytest.mark.parametrize("policy", POLICIES, ids=lambda p: str(p.max_group_rows))
def test_overview(golden, policy):
    row = cases.overview(golden, policy=policy).first().asDict()
    assert (row["case_count"], row["event_count"], row["activity_count"]) == (3, 10, 4)
    assert row["median_throughput_ms"] == 420_000
    assert row["p90_throughput_ms"] == pytest.approx(516_000)
    assert row["rework_rate"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("policy", POLICIES, ids=lambda p: str(p.max_group_rows))
def test_empty_log(golden, policy):
    empty = filters.in_range(golden, datetime(2030, 1, 1))
    assert edges_of(empty, policy=policy) == []
    assert dfg.dfg_nodes(empty).count() == 0
    row = cases.overview(empty, policy=policy).first()
    assert (row.case_count, row.event_count, row.activity_count, row.rework_rate) == (0, 0, 0, 0.0)
    assert row.median_throughput_ms is None and row.p90_throughput_ms is None


def test_range_must_be_ordered():
    with pytest.raises(ValueError):
        EventFilter(date_from=datetime(2026, 1, 2), date_to=datetime(2026, 1, 2))


def test_event_filter_truncates_and_case_filter_does_not(golden):
    spec = EventFilter(date_from=datetime(2026, 1, 1, 9, 1), date_to=datetime(2026, 1, 1, 9, 3))
    assert filters.filter_events(golden, spec).count() == 1
    assert filters.filter_cases(golden, spec).count() == 3


def test_variants(golden):
    top = {r.variant_sequence: r.case_count for r in variants.variants_top(golden).collect()}
    assert top == {"A > B > C": 1, "A > B > B > C": 1, "A > D > C": 1}
    coverage = variants.variant_coverage(golden).collect()
    assert max(r.cumulative_share for r in coverage) == pytest.approx(1.0)


@pytest.mark.parametrize("policy", POLICIES, ids=lambda p: str(p.max_group_rows))
def test_paths(golden, policy):
    exact = paths.cases_with_exact_path(golden, ["A", "B", "C"], policy)
    assert [r.case_id for r in exact.collect()] == ["CASE-001"]
    ordered = paths.cases_with_ordered_path(golden, ["A", "B", "C"], policy)
    assert sorted(r.case_id for r in ordered.collect()) == ["CASE-001", "CASE-002"]
    twice = paths.cases_with_ordered_path(golden, ["B", "B"], policy)
    assert [r.case_id for r in twice.collect()] == ["CASE-002"]
    assert paths.repeated_paths(golden, 1, policy).collect() == [("CASE-002", "B", 2)]


def test_sums_agree(golden):
    edges = sum(e[2] for e in edges_of(golden))
    assert edges == len(GOLDEN) - 3
    assert sum(r.case_count for r in variants.variant_summary(golden).collect()) == 3
    assert sum(r.case_count for r in cases.start_activities(golden).collect()) == 3
    assert sum(r.case_count for r in cases.end_activities(golden).collect()) == 3


def test_graph_views(golden):
    edges = dfg.dfg_edges(golden)
    assert dfg.frequent_edges(edges, 2).count() == 2
    assert dfg.without_self_loops(edges).count() == 4
    assert [r.source for r in dfg.self_loops(edges).collect()] == ["B"]
    assert dfg.low_support(edges, 2).filter("low_support").count() == 3
    with pytest.raises(ValueError):
        dfg.weighted_edges(edges, "speed")


def test_case_search_pages(golden):
    first = [r.case_id for r in cases.search_cases(golden, page_size=2).collect()]
    rest = [r.case_id for r in cases.search_cases(golden, page_size=2, after_case_id=first[-1]).collect()]
    assert first + rest == ["CASE-001", "CASE-002", "CASE-003"]
    line = cases.case_timeline(golden, "CASE-002", 2).collect()
    assert [(r.event_position, r.activity, r.next_activity) for r in line] == [(1, "A", "B"), (2, "B", "B")]
