"""Maximal repeats of any length against all pairs of positions."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomtrail.operators import repeats as module
from loomtrail.operators.repeats import _counted, maximal_repeats, nearest_smaller, repeat_steps
from loomtrail.scale import ScalePolicy, plan_bytes, stage

from conftest import as_log


def brute(cases, least):
    out = set()
    for case, steps in cases.items():
        places = defaultdict(list)
        for i in range(len(steps)):
            for j in range(i + least, len(steps) + 1):
                places[tuple(steps[i:j])].append(i)
        for path, at in places.items():
            before = {steps[i - 1] if i else "^" for i in at}
            after = {steps[i + len(path)] if i + len(path) < len(steps) else "$" for i in at}
            if len(at) > 1 and len(before) > 1 and len(after) > 1:
                out.add((case, path, len(at)))
    return out


def log_of(spark, cases):
    rows, n = [], 0
    for case, steps in cases.items():
        for k, a in enumerate(steps):
            n += 1
            rows.append((f"e{n:06d}", case, a, str(datetime(2024, 1, 1) + timedelta(minutes=k // 3)), n))
    random.Random(1).shuffle(rows)
    return stage(as_log(spark, rows), "repeats-log")


def found(log, least, policy):
    repeats = stage(maximal_repeats(log, least, policy), "repeats")
    steps = repeat_steps(log, repeats, policy).withColumn("s", F.struct("step", "step_activity"))
    rows = steps.groupBy("case_id", "position", "length", "occurrences").agg(F.array_sort(F.collect_list("s")).alias("s")).collect()
    assert len(rows) == repeats.count()
    assert all(len(r.s) == r.length for r in rows)
    return {(r.case_id, tuple(s.step_activity for s in r.s), r.occurrences) for r in rows}


@pytest.mark.parametrize("bound", [1_000_000, 40])
def test_against_all_pairs(spark, bound):
    rng = random.Random(bound)
    cases = {f"c{k}": [rng.choice("ABC") for _ in range(rng.randrange(1, 25))] for k in range(20)}
    loop = [rng.choice("ABCD") for _ in range(17)]
    cases["hot"] = loop * 4 + [rng.choice("ABCD") for _ in range(30)] + loop[3:] * 2
    cases["same"] = ["A"] * 70
    cases["gaps"] = ["A", None, "B", "A", None, "B", "", "A", None]
    cases["one"] = ["A"]
    log = log_of(spark, cases)
    least = 1 if bound > 100 else 2
    assert found(log, least, ScalePolicy(max_group_rows=bound)) == brute(cases, least)


def test_tables_that_grow_are_merged(spark, monkeypatch):
    """Small files may hold many rows: their counted rows decide, and the merged form finds the same."""
    ranks = stage(spark.range(500_000).select("id", F.lit("case").alias("case_id")), "repeat-ranks")
    assert plan_bytes(ranks) < 10 << 20
    told = _counted(ranks, ScalePolicy())._jdf.queryExecution().analyzed().toString()
    assert "strategy=merge" in told and "strategy=broadcast" not in told
    few = _counted(stage(ranks.limit(10), "repeat-ranks"), ScalePolicy())
    assert "strategy=broadcast" in few._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(module, "KEYED_BYTES", 0)
    cases = {"a": list("ABABCABAB"), "b": list("CCCC"), "c": ["A"] * 9}
    assert found(log_of(spark, cases), 2, ScalePolicy()) == brute(cases, 2)


def test_nothing_repeats(spark):
    assert maximal_repeats(log_of(spark, {"a": list("ABC"), "b": list("ABC")}), 1).count() == 0
    assert maximal_repeats(log_of(spark, {"a": ["A"]}).where("false")).count() == 0


def test_nearest_smaller(spark):
    rng = random.Random(3)
    numbers = [0] + [rng.choice([1, 2, 3, 9]) if rng.random() < 0.01 else rng.randrange(5, 9) for _ in range(9000)] + [-1]
    values = spark.createDataFrame(list(enumerate(numbers)), "at long, value long")
    wanted = values.where("value > 0").select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("right"))
    got = {(r["at"], r["right"]): r["found"] for r in nearest_smaller(values, wanted).collect()}
    want = {}
    for i, v in enumerate(numbers):
        if v > 0:
            want[i, False] = next(j for j in range(i - 1, -1, -1) if numbers[j] < v)
            want[i, True] = next(j for j in range(i + 1, len(numbers)) if numbers[j] < v)
    assert got == want
