"""The index of cases against sets of cases."""

import random
from datetime import datetime, timedelta

import pytest

from loomtrail.operators import caseindex
from loomtrail.operators.caseindex import any_of, has
from loomtrail.operators.variants import case_traces
from loomtrail.scale import stage, staged_path

from conftest import as_log


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(6)
    rows = []
    for k in range(2000):
        case = "hot" if k % 3 == 0 else f"c{rng.randrange(300)}"
        at = datetime(2024, 1, 1) + timedelta(hours=rng.randrange(100))
        rows.append((f"e{k}", case, rng.choice("ABCD") if case != "hot" else "A", str(at), k))
    log = as_log(spark, rows).selectExpr("*", "case when activity = 'D' then 'bad' when activity = 'C' then null else 'ok' end as result_code")
    log = stage(log, "indexed-log")
    return log, caseindex.build(log, staged_path(spark, "index"), slots=32)


def test_conditions(spark, indexed):
    log, root = indexed
    rows = log.select("case_id", "activity", "result_code").collect()
    every = {r.case_id for r in rows}
    act = {a: {r.case_id for r in rows if r.activity == a} for a in "ABCDX"}
    code = {c: {r.case_id for r in rows if r.result_code == c} for c in ("ok", "bad")}
    conditions = {
        has("activity", "A"): act["A"],
        has("activity", "A") & ~has("activity", "B"): act["A"] - act["B"],
        ~(any_of("activity", ["B", "C"]) | has("result_code", "bad")): every - (act["B"] | act["C"] | code["bad"]),
        has("activity", "X"): set(), ~has("activity", "X"): every,
        has("result_code", "ok") & ~has("activity", "A"): code["ok"] - act["A"],
    }
    for condition, want in conditions.items():
        assert {r.case_id for r in caseindex.search(spark, root, condition).collect()} == want
        assert caseindex.count_cases(spark, root, condition).first().case_count == len(want)


def test_variants_and_days(spark, indexed):
    log, root = indexed
    hashes = case_traces(log).where("case_id in ('c1', 'hot')").collect()
    found = caseindex.search(spark, root, any_of("variant", [r.variant_hash for r in hashes])).collect()
    assert {r.case_id for r in found} >= {"c1", "hot"}
    days = {r.case_id: str(r.first)[:10] for r in log.groupBy("case_id").agg({"event_ts": "min"}).toDF("case_id", "first").collect()}
    got = {r.case_id for r in caseindex.search(spark, root, has("started", "2024-01-02")).collect()}
    assert got == {c for c, d in days.items() if d == "2024-01-02"}


def test_only_slots_of_found_cases_are_read(spark, indexed):
    log, root = indexed
    found = caseindex.search(spark, root, ~any_of("activity", ["A", "B"]))
    got = caseindex.events(spark, root, found)
    wanted = {r.case_id for r in found.collect()}
    assert got.count() == sum(r.case_id in wanted for r in log.select("case_id").collect()) > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert any("slot#" in p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:])
    terms = caseindex.matching_words(spark, root, has("activity", "A"))._jdf.queryExecution().executedPlan().toString()
    assert "field#" in terms.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(value,A)" in terms


def test_no_values():
    with pytest.raises(ValueError):
        any_of("activity", [])
