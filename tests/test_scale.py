"""Split forms against brute force on skewed data, and the shape of plans."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_log
from loomtrail.functions.quantiles import split_quantiles, value_bin
from loomtrail.functions.timing import millis_between, use_utc
from loomtrail.operators import cases, dfg, paths, running, variants, vartree
from loomtrail.operators import normalize as norm
from loomtrail.operators.sequence import follow, split_cases, transitions
from loomtrail.plans import dirty
from loomtrail.plans.logs import user_log
from loomtrail.scale import ScalePolicy, broadcast_checked, plan_bytes, shared_folder, stage, staging

SPLIT = ScalePolicy(max_group_rows=40)
SF = "/root/testdata/sf0.001"


def skewed_rows(seed=5, n=900):
    """One case holds a third of all events, and half of those share one timestamp."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        case = "HOT" if hot else f"c{rng.randrange(60)}"
        minute = 0 if hot and i % 2 == 0 else rng.randrange(600)
        t = f"2026-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
        rows.append((f"e{i:05d}", case, rng.choice("ABC"), t, rng.choice([None, rng.randrange(50)])))
    return rows


ROWS = skewed_rows()


def brute_traces():
    by_case = defaultdict(list)
    for e, c, a, t, s in ROWS:
        by_case[c].append(((t, s is None, s or 0, e), a, t, e))
    return {c: [(a, t, e) for _, a, t, e in sorted(v)] for c, v in by_case.items()}


@pytest.fixture(scope="module")
def skewed(spark):
    return as_log(spark, ROWS).cache()


def test_split_cuts_the_hot_case(skewed):
    split = split_cases(skewed, SPLIT)
    sizes = [r["count"] for r in split.pieces.groupBy("case_id", "piece").count().collect()]
    assert sum(sizes) == 300 and len(sizes) >= 6 and max(sizes) < 150
    assert split.whole.filter("case_id = 'HOT'").count() == 0


def test_tasks_follow_the_rows_and_not_the_bound(spark):
    """Many small pieces share a task; a piece never holds more rows than the bound and follows the one before it."""
    log = user_log(spark, SF)
    log = log.unionByName(log.withColumn("case_id", F.concat("case_id", F.lit("-b"))))
    pieces = split_cases(log, ScalePolicy(max_group_rows=7)).pieces
    assert len(pieces.inputFiles()) <= 2
    held = pieces.groupBy("piece").agg(
        F.count("*").alias("n"),
        F.min(F.struct("case_id", "event_ts", "ingest_sequence")).alias("first"),
        F.max(F.struct("case_id", "event_ts", "ingest_sequence")).alias("last"),
    ).orderBy("piece").collect()
    assert len(held) > 200 and max(r["n"] for r in held) == 7
    assert all(a["last"] < b["first"] for a, b in zip(held, held[1:]))


@pytest.mark.parametrize("policy", [ScalePolicy(), SPLIT], ids=lambda p: str(p.max_group_rows))
def test_successors_and_positions(skewed, policy):
    got = {r.event_id: (r.event_position, r.next_activity) for r in follow(skewed, policy, position=True).collect()}
    expected = {}
    for trace in brute_traces().values():
        for i, (_, _, e) in enumerate(trace):
            expected[e] = (i + 1, trace[i + 1][0] if i + 1 < len(trace) else None)
    assert got == expected


def test_edges_agree(skewed):
    whole = [tuple(r) for r in dfg.dfg_edges(skewed, policy=ScalePolicy()).collect()]
    split = [tuple(r) for r in dfg.dfg_edges(skewed, policy=SPLIT).collect()]
    assert [w[:4] for w in whole] == [s[:4] for s in split]
    assert np.allclose([w[4:] for w in whole], [s[4:] for s in split])
    assert sum(w[2] for w in whole) == len(ROWS) - len({r[1] for r in ROWS})


def test_variant_hash_ignores_the_cut(skewed, monkeypatch):
    monkeypatch.setattr(variants, "CHUNK", 7)  # three levels for the hot case
    whole = {r.case_id: r for r in variants.case_traces(skewed, F.col("activity") == "C", ScalePolicy()).collect()}
    split = {r.case_id: r for r in variants.case_traces(skewed, F.col("activity") == "C", SPLIT).collect()}
    other = {r.case_id: r for r in variants.case_traces(skewed, F.col("activity") == "C", ScalePolicy(max_group_rows=9)).collect()}
    key = lambda r: (r.variant_hash, r.throughput_ms, r.event_count, r.has_rework, r.has_failure)
    assert {c: key(r) for c, r in whole.items()} == {c: key(r) for c, r in split.items()}
    assert {c: key(r) for c, r in whole.items()} == {c: key(r) for c, r in other.items()}


def test_short_hash_is_plain(skewed):
    trace = brute_traces()
    got = {r.case_id: r.variant_hash for r in variants.case_traces(skewed, policy=SPLIT).collect()}
    for case, steps in trace.items():
        assert got[case] == hashlib.sha256("\x1f".join(a for a, _, _ in steps).encode()).hexdigest()


@pytest.mark.parametrize("policy", [ScalePolicy(), SPLIT], ids=lambda p: str(p.max_group_rows))
def test_paths_against_brute_force(skewed, policy):
    text = {c: "".join(a for a, _, _ in t) for c, t in brute_traces().items()}
    exact = {r.case_id: r.occurrences for r in paths.cases_with_exact_path(skewed, list("ABA"), policy).collect()}
    count = lambda s: sum(s[i : i + 3] == "ABA" for i in range(len(s)))
    assert exact == {c: count(s) for c, s in text.items() if count(s)}

    def ordered(s, path="CABCAB"):
        it = iter(s)
        return all(p in it for p in path)

    found = {r.case_id for r in paths.cases_with_ordered_path(skewed, list("CABCAB"), policy).collect()}
    assert found == {c for c, s in text.items() if ordered(s)}
    runs = {(r.case_id, r.path): r.occurrences for r in paths.repeated_paths(skewed, 4, policy).collect()}
    expected = Counter((c, " > ".join(s[i : i + 4])) for c, s in text.items() for i in range(len(s) - 3))
    assert runs == {k: n for k, n in expected.items() if n > 1}


def test_running_total_agrees(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 101).alias("v")).repartition(5)
    order = [F.desc("v"), F.col("id").asc()]
    whole = {tuple(r) for r in running.ranked_running_total(df, order, "v", ScalePolicy()).collect()}
    split = {tuple(r) for r in running.ranked_running_total(df, order, "v", ScalePolicy(max_group_rows=1)).collect()}
    assert whole == split


def test_value_bins_keep_order(spark):
    values = sorted({s * (b + d) for s in (1, -1) for e in range(0, 62) for b in [1 << e] for d in (-1, 0, 1, 3)})
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", value_bin(F.col("v")))
    bins = [r.b for r in df.orderBy("v").collect()]
    assert bins == sorted(bins) and len(set(bins)) > 150


def test_split_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {
        "hot": np.concatenate([np.full(4000, 77), rng.integers(-50, 10**9, 2000)]),
        "one": np.array([12345]),
        "two": np.array([-10, 10**12]),
        "wide": rng.integers(-(10**12), 10**12, 501),
    }
    rows = [(g, int(v)) for g, vs in groups.items() for v in vs]
    data = spark.createDataFrame(rows, "g string, v long")
    wanted = {"q0": 0.0, "q50": 0.5, "q90": 0.9, "q95": 0.95, "q100": 1.0}
    for r in split_quantiles(data, ["g"], "v", wanted).collect():
        for q, p in wanted.items():
            assert r[q] == pytest.approx(np.quantile(groups[r.g], p), rel=1e-12), (r.g, q)


def test_one_duplicate_key_on_most_rows(spark):
    rows = [(i, None, None, None, "x") for i in range(600)] + [(600 + i, f"e{i}", "C", "A", "2026-01-01") for i in range(300)]
    raw = spark.createDataFrame(rows, "source_row_number long, e string, c string, a string, t string")
    from loomtrail.model import ColumnBinding

    binding = ColumnBinding("c", "a", "t", "e")
    results = []
    for bound in (1000, 10):
        checked = norm.validate(raw, binding, policy=ScalePolicy(max_group_rows=bound))
        columns = ["source_row_number", "duplicate_event", "duplicate_timestamp", "same_timestamp_count", "is_valid"]
        results.append(sorted(tuple(r) for r in checked.select(*columns).collect()))
    assert results[0] == results[1]
    assert sum(r[1] for r in results[0]) == 600


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_down_and_prune(spark):
    from datetime import datetime

    from loomtrail.operators.filters import in_range

    log = in_range(user_log(spark, SF), datetime(2024, 1, 5), datetime(2024, 1, 20))
    plan = plan_of(transitions(log))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan
    assert "props" not in plan.split("ReadSchema")[1] and "value" not in plan.split("ReadSchema")[1].split("\n")[0]
    for df in (dfg.dfg_edges(log), dfg.dfg_nodes(log), cases.overview(log), variants.variant_summary(log)):
        text = plan_of(df)
        assert "Cartesian" not in text and "NestedLoop" not in text and "Python" not in text


def test_no_python_in_normalization_plan(spark):
    use_utc(spark)
    checked = norm.validate(dirty.raw_log(spark, SF), dirty.BINDING, dirty.CONTRACT)
    text = plan_of(norm.canonical_events(checked, dirty.BINDING, dirty.CONTRACT, "d", dirty.KEY))
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_counted_rows_decide_not_estimates(spark):
    """A small table blown up to one large case is estimated small, and split all the same."""
    small = user_log(spark, SF).limit(20).withColumn("case_id", F.lit("ONE"))
    exploded = small.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n")
    assert plan_bytes(exploded) < 1 << 20
    assert split_cases(exploded, ScalePolicy(max_group_rows=1000)).pieces is not None
    assert split_cases(exploded, ScalePolicy()).pieces is None
    with pytest.raises(ValueError):
        ScalePolicy(max_group_rows=0)


def test_exploded_sides_get_no_hint(spark):
    table = spark.read.parquet(f"{SF}/nation.parquet")
    hint = "ResolvedHint"
    plan = broadcast_checked(table)._jdf.queryExecution().analyzed().toString()
    assert hint in plan
    blown = table.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(9))))
    assert hint not in broadcast_checked(blown)._jdf.queryExecution().analyzed().toString()


def test_quantiles_divide_full_bins(spark):
    """Most values lie in one logarithmic bin; bins are divided until the bound holds."""
    rng = random.Random(3)
    values = [10_000_000_000 + rng.randrange(30_000_000) for _ in range(3000)] + [5] * 50 + [-7] * 9
    df = spark.createDataFrame([("g", v) for v in values], "g string, v long")
    wanted = {"lo": 0.01, "mid": 0.5, "hi": 0.999}
    got = split_quantiles(df, ["g"], "v", wanted, ScalePolicy(max_group_rows=40)).first()
    for q, p in wanted.items():
        assert got[q] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_missing_activities_are_steps(spark):
    log = as_log(spark, [("1", "a", "A", "2026-01-01", 1), ("2", "a", None, "2026-01-02", 2), ("3", "b", "A", "2026-01-01", 1)])
    assert variants.variant_counts(variants.case_traces(log)).count() == 2


def test_paths_are_told_apart_by_steps(spark):
    rows, n = [], 0
    for label in ["A > B", "C", "x", "A", "B > C"]:
        n += 1
        rows.append((str(n), "c", label, f"2026-01-{n:02d}", n))
    assert paths.repeated_paths(as_log(spark, rows), 2).count() == 0


def test_times_do_not_depend_on_the_session_zone(spark):
    row = spark.createDataFrame([("2026-03-08 01:30:00.5", "2026-03-08 03:30:00")], "a string, b string")
    row = row.select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert row.select(millis_between(F.col("a"), F.col("b"))).first()[0] == 7_199_500
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_staged_tables_go_when_their_scope_ends(spark):
    with staging(spark):
        df = stage(spark.range(5), "scope")
        path = df.inputFiles()[0]
        assert df.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_shared_folder_is_asked_for(spark):
    class Context:
        applicationId, master = "other", "spark://host:7077"

        def getCheckpointDir(self):
            return self.folder

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    Session.sparkContext.folder = None
    with pytest.raises(RuntimeError):
        shared_folder(Session())
    Session.sparkContext.folder = "hdfs://x/y/"
    assert shared_folder(Session()) == "hdfs://x/y"


@pytest.mark.parametrize("bound", [2, 5, 1000])
def test_runs_across_short_pieces(spark, bound):
    names = [("x" if k % 5 else None) if k % 7 else f"a{k % 3}" for k in range(40)]
    rows = [(f"e{k}", "big", a, "2026-01-01 10:00:00", k) for k, a in enumerate(names)]
    rows += [("s1", "small", "x", "2026-01-01 10:00:00", 1), ("s2", "small", "y", "2026-01-01 10:00:00", 2)]
    got = paths.path_occurrences(as_log(spark, rows), 6, ScalePolicy(max_group_rows=bound)).collect()
    assert sorted((r.start_position, r.path) for r in got) == [(k + 1, names[k : k + 6]) for k in range(35)]
    assert {r.case_id for r in got} == {"big"}


def test_variant_tree(spark):
    rows = [*ROWS, *[(f"n{k}", case, None if k == 1 else "A", f"2026-01-02 00:0{k}:00", None) for case in ("x", "y") for k in range(3)],
            ("m", "z", "", "2026-01-02 00:00:00", None)]
    log = as_log(spark, rows)
    ordered = defaultdict(list)
    for r in follow(log, position=True).collect():
        ordered[r.case_id].append((r.event_position, r.activity))
    traces = {c: tuple(a for _, a in sorted(v)) for c, v in ordered.items()}
    passing, ending = defaultdict(list), Counter(traces.values())
    for c, t in traces.items():
        for d in range(1, len(t) + 1):
            passing[t[:d]].append(c)
    children = Counter(t[:-1] for t in passing)
    want = sorted(
        (len(t), str(t[-1]), len(c), ending[t], children[t], len(c) / len(traces),
         len(c) / len(passing.get(t[:-1], traces)), min(c))
        for t, c in passing.items()
    )
    columns = "depth activity case_count ending_cases n_children case_share parent_share first_case_id".split()
    for policy in (ScalePolicy(), SPLIT, ScalePolicy(max_group_rows=3)):
        tree = stage(vartree.variant_tree(log, policy), "tree")
        got = sorted(tuple(str(r[c]) if c == "activity" else r[c] for c in columns) for r in tree.collect())
        assert got == [tuple(w) for w in want]
        spelled = defaultdict(dict)
        for r in vartree.node_steps(log, vartree.split_points(tree), policy).collect():
            spelled[r.depth, r.word_1, r.word_2][r.step] = r.step_activity
        ways = {t for t in passing if len(passing[t]) > 1 and children[t] + (ending[t] > 0) > 1}
        assert {tuple(v[k] for k in sorted(v)) for v in spelled.values()} == ways
    plan = vartree.case_beginnings(log)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    assert vartree.variant_tree(log.limit(0)).count() == 0
