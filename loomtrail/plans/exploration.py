"""Filters, case facts, variants, paths and failure reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loomtrail.model import ORDER_KEYS, EventFilter
from loomtrail.operators import caseindex, cases, filters, paths, repeats, variants, vartree
from loomtrail.operators.dfg import dfg_edges
from loomtrail.plans.graph import SPLIT
from loomtrail.plans.logs import (
    CASES, DAY_LOG, EDGE_COLUMNS, EDGES, FAILED, LINE_LOG, ORDER_LOG, ORDERED, STEPS, TALK_LOG, TRACES, USER_LOG,
    day_log, line_log, order_log, talk_log, user_log,
)
from loomtrail.plans.registry import query, ts_text
from loomtrail.scale import ScalePolicy, stage, staged_path

JAN_5, JAN_20 = datetime(2024, 1, 5), datetime(2024, 1, 20)
SMALL_PIECES = ScalePolicy(max_group_rows=7)

_EVENT = f"event_id, case_id, activity, {ts_text('event_ts')} AS event_ts"


def is_failed():
    return F.col("result_code") == FAILED


def _event(df):
    return df.select("event_id", "case_id", "activity", "event_ts")


# --- filters -----------------------------------------------------------------------------------

_RANGE = "event_ts >= TIMESTAMP '2024-01-05' AND event_ts < TIMESTAMP '2024-01-20'"


@query("F01_event_time_range", f"WITH {USER_LOG} SELECT {_EVENT} FROM log WHERE {_RANGE}")
def _(spark, d):
    return _event(filters.in_range(user_log(spark, d), JAN_5, JAN_20))


@query(
    "F01_dfg_in_range",
    f"WITH all_{USER_LOG}, log AS (SELECT * FROM all_log WHERE {_RANGE}), {STEPS}, {EDGES} SELECT {EDGE_COLUMNS} FROM edges",
)
def _(spark, d):
    return dfg_edges(filters.in_range(user_log(spark, d), JAN_5, JAN_20))


@query(
    "F02_validated_range",
    f"WITH {USER_LOG} SELECT count(*) AS event_count FROM log WHERE {_RANGE}",
)
def _(spark, d):
    spec = EventFilter(date_from=JAN_5, date_to=JAN_20)  # raises unless from < to
    return filters.filter_events(user_log(spark, d), spec).agg(F.count("*").alias("event_count"))


@query(
    "F07_wide_filter",
    f"""WITH {USER_LOG} SELECT {_EVENT}, org_code, result_code FROM log
WHERE process_domain = 'WEB' AND org_code IN ('ORG-0', 'ORG-2') AND result_code = 'OK'
  AND activity IN ('click', 'view', 'purchase') AND activity <> 'view' AND {_RANGE}""",
)
def _(spark, d):
    spec = EventFilter(
        date_from=JAN_5,
        date_to=JAN_20,
        process_domains=("WEB",),
        attributes={"org_code": ("ORG-0", "ORG-2")},
        result_codes=("OK",),
        include_activities=("click", "view", "purchase"),
        exclude_activities=("view",),
        mapping_version="mapping-v1",
    )
    return filters.filter_events(user_log(spark, d), spec).select(
        "event_id", "case_id", "activity", "event_ts", "org_code", "result_code"
    )


@query(
    "F08_case_filter",
    f"""WITH {DAY_LOG} SELECT {_EVENT} FROM log
WHERE case_id IN (SELECT case_id FROM log WHERE activity = 'purchase' AND {_RANGE})""",
)
def _(spark, d):
    spec = EventFilter(date_from=JAN_5, date_to=JAN_20, include_activities=("purchase",))
    return _event(filters.filter_cases(day_log(spark, d), spec))


_TOP_VARIANTS = "best AS (SELECT variant_hash FROM traces GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)"


@query(
    "F11_variant_filter",
    f"""WITH {DAY_LOG}, {TRACES}, {_TOP_VARIANTS} SELECT {_EVENT} FROM log
WHERE case_id IN (SELECT case_id FROM traces WHERE variant_hash IN (FROM best))""",
)
def _(spark, d):
    log = day_log(spark, d)
    top = variants.ranked_variants(log, limit=3).select("variant_hash")
    return _event(filters.keep_cases(log, variants.filter_variants(log, top).select("case_id").distinct()))


# --- case facts --------------------------------------------------------------------------------

_SUMMARY = f"""WITH {{log}}, {CASES} SELECT case_id, {ts_text('first_ts')} AS case_start_ts,
  {ts_text('last_ts')} AS case_end_ts, took AS throughput_ms, n AS event_count, kinds AS distinct_activity_count,
  n > kinds AS has_rework FROM cases"""


@query("A05_case_summary", _SUMMARY.format(log=USER_LOG))
def _(spark, d):
    return cases.case_summary(user_log(spark, d))


@query("A05_case_summary_lines", _SUMMARY.format(log=LINE_LOG))
def _(spark, d):
    return cases.case_summary(line_log(spark, d))


@query(
    "A06_activity_per_case",
    f"WITH {USER_LOG} SELECT case_id, activity, count(*) AS activity_count FROM log GROUP BY ALL",
)
def _(spark, d):
    return cases.activity_per_case(user_log(spark, d)).select("case_id", "activity", "activity_count")


@query(
    "A07_rework_cases",
    f"WITH {DAY_LOG}, {CASES} SELECT case_id FROM cases WHERE n > kinds",
)
def _(spark, d):
    return cases.rework_cases(day_log(spark, d))


@query("D01_distinct_cases", f"WITH {DAY_LOG} SELECT DISTINCT case_id FROM log WHERE activity = 'error'")
def _(spark, d):
    return filters.matching_cases(day_log(spark, d), EventFilter(include_activities=("error",)))


@query(
    "A07_rework_rate",
    f"""WITH {DAY_LOG}, {CASES} SELECT count_if(n > kinds) AS rework_cases, count(*) AS total_cases,
  round(count_if(n > kinds) / CAST(count(*) AS DOUBLE), 6) AS rework_rate FROM cases""",
)
def _(spark, d):
    return cases.rework_rate(day_log(spark, d))


_OVERVIEW = f"""WITH {DAY_LOG}, {CASES}
SELECT count(*) AS case_count, CAST(sum(n) AS BIGINT) AS event_count,
  (SELECT count(DISTINCT activity) FROM log) AS activity_count,
  round(quantile_cont(took, 0.5), 3) AS median_throughput_ms, round(quantile_cont(took, 0.9), 3) AS p90_throughput_ms,
  round(count_if(n > kinds) / CAST(count(*) AS DOUBLE), 6) AS rework_rate FROM cases"""


@query("A08_overview", _OVERVIEW)
def _(spark, d):
    return cases.overview(day_log(spark, d))


@query("A08_overview_split", _OVERVIEW)
def _(spark, d):
    return cases.overview(day_log(spark, d), policy=SPLIT)


@query(
    "J05_overview_empty",
    f"""WITH {USER_LOG} SELECT count(DISTINCT case_id) AS case_count, count(*) AS event_count,
  count(DISTINCT activity) AS activity_count, CAST(NULL AS DOUBLE) AS median_throughput_ms,
  CAST(NULL AS DOUBLE) AS p90_throughput_ms, CAST(0 AS DOUBLE) AS rework_rate
FROM log WHERE event_ts >= TIMESTAMP '2030-01-01'""",
)
def _(spark, d):
    return cases.overview(filters.in_range(user_log(spark, d), datetime(2030, 1, 1)))


@query(
    "M08_failure_rate_kpi",
    f"""WITH {USER_LOG}, {CASES}
SELECT count(*) AS case_count, CAST(sum(n) AS BIGINT) AS event_count,
  (SELECT count(DISTINCT activity) FROM log) AS activity_count,
  round(quantile_cont(took, 0.5), 3) AS median_throughput_ms, round(quantile_cont(took, 0.9), 3) AS p90_throughput_ms,
  round(count_if(n > kinds) / CAST(count(*) AS DOUBLE), 6) AS rework_rate,
  (SELECT round(count_if(result_code = 'FAILED') / CAST(count(*) AS DOUBLE), 6) FROM log) AS failure_rate FROM cases""",
)
def _(spark, d):
    return cases.overview(user_log(spark, d), failure=is_failed())


_THROUGHPUT = f"""WITH {ORDER_LOG}, {CASES}
SELECT round(avg(took), 3) AS avg_throughput_ms, max(took) AS max_throughput_ms,
  round(quantile_cont(took, 0.5), 3) AS median_throughput_ms, round(quantile_cont(took, 0.75), 3) AS p75_throughput_ms,
  round(quantile_cont(took, 0.9), 3) AS p90_throughput_ms, round(quantile_cont(took, 0.95), 3) AS p95_throughput_ms
FROM cases"""


@query("A09_throughput_statistics", _THROUGHPUT)
def _(spark, d):
    return cases.throughput_statistics(order_log(spark, d))


@query("A09_throughput_statistics_split", _THROUGHPUT)
def _(spark, d):
    return cases.throughput_statistics(order_log(spark, d), SPLIT)


_REWORK_BY = f"""WITH {DAY_LOG}, per AS (SELECT case_id, activity, count(*) AS n FROM log GROUP BY ALL)
SELECT activity, count_if(n >= 2) AS rework_case_count, count(*) AS cases_with_activity,
  round(count_if(n >= 2) / CAST(count(*) AS DOUBLE), 6) AS rework_case_rate FROM per GROUP BY activity"""


@query("A10_rework_by_activity", _REWORK_BY)
def _(spark, d):
    return cases.rework_by_activity(day_log(spark, d))


@query("L06_rework_ranking", f"{_REWORK_BY} ORDER BY rework_case_rate DESC, rework_case_count DESC, activity LIMIT 3")
def _(spark, d):
    return cases.rework_by_activity(day_log(spark, d)).limit(3)


@query("A17_conditional_count", f"WITH {USER_LOG} SELECT activity, count_if(duration_ms > 5000) AS slow_events FROM log GROUP BY 1")
def _(spark, d):
    return user_log(spark, d).groupBy("activity").agg(F.count_if(F.col("duration_ms") > 5000).alias("slow_events"))


@query(
    "M01_activity_frequency",
    f"WITH {DAY_LOG} SELECT activity, count(*) AS event_count, count(DISTINCT case_id) AS case_count FROM log GROUP BY 1",
)
def _(spark, d):
    return (
        day_log(spark, d)
        .groupBy("activity")
        .agg(F.count("*").alias("event_count"), F.count_distinct("case_id").alias("case_count"))
    )


for _key, _log, _sql, _fn, _pick in (
    ("M02_start_activities", day_log, DAY_LOG, cases.start_activities, "arg_min"),
    ("M02_end_activities", day_log, DAY_LOG, cases.end_activities, "arg_max"),
):

    def _ends(spark, d, log=_log, fn=_fn):
        return fn(log(spark, d))

    _at = "first" if _pick == "arg_min" else "last"
    query(
        _key,
        f"""WITH {_sql}, ends AS (SELECT {_at}(activity ORDER BY {ORDERED}) AS activity FROM log GROUP BY case_id)
SELECT activity, count(*) AS case_count FROM ends GROUP BY 1""",
    )(_ends)


@query(
    "M02_case_ends_orders",
    f"""WITH {ORDER_LOG} SELECT case_id, first(activity ORDER BY {ORDERED}) AS start_activity,
  last(activity ORDER BY {ORDERED}) AS end_activity FROM log GROUP BY case_id""",
)
def _(spark, d):
    return cases.case_ends(order_log(spark, d))


@query(
    "M16_slowest_cases",
    f"""WITH {DAY_LOG}, {CASES} SELECT case_id, {ts_text('first_ts')} AS case_start_ts, {ts_text('last_ts')} AS case_end_ts,
  n AS event_count, took AS throughput_ms FROM cases ORDER BY took DESC, case_id LIMIT 20""",
)
def _(spark, d):
    return cases.slowest_cases(day_log(spark, d), 20)


@query(
    "M11_case_timeline",
    f"""WITH {USER_LOG}, {STEPS} SELECT event_id, case_id, activity, {ts_text('event_ts')} AS event_ts,
  pos AS event_position, target AS next_activity, {ts_text('next_ts')} AS next_event_ts
FROM steps WHERE case_id = '7' AND pos <= 25""",
)
def _(spark, d):
    return cases.case_timeline(user_log(spark, d), "7", 25)


_PAGE = f"""case_id, {ts_text('first_ts')} AS case_start_ts, {ts_text('last_ts')} AS case_end_ts,
  n AS event_count, took AS throughput_ms"""


@query(
    "M12_case_search",
    f"""WITH {DAY_LOG}, {CASES} SELECT {_PAGE} FROM cases
WHERE case_id > '12' AND case_id IN (SELECT case_id FROM log WHERE {_RANGE})
  AND case_id IN (SELECT case_id FROM log WHERE activity = 'signup') ORDER BY case_id LIMIT 50""",
)
def _(spark, d):
    return cases.search_cases(
        day_log(spark, d), date_from=JAN_5, date_to=JAN_20, activity="signup", after_case_id="12", page_size=50
    )


@query(
    "M12_case_search_by_variant",
    f"""WITH {DAY_LOG}, {CASES}, {TRACES}, {_TOP_VARIANTS} SELECT {_PAGE} FROM cases
WHERE case_id IN (SELECT case_id FROM traces WHERE variant_hash IN (FROM best)) ORDER BY case_id LIMIT 100""",
)
def _(spark, d):
    log = day_log(spark, d)
    top = variants.ranked_variants(log, limit=3).select("variant_hash")
    return cases.search_cases(log, variant_cases=variants.filter_variants(log, top).select("case_id").distinct())


_INDEXED = f"""WITH {DAY_LOG}, sets AS (SELECT case_id, bool_or(activity = 'purchase') AS bought, bool_or(activity = 'click') AS clicked,
    bool_or(result_code = 'FAILED') AS failed, min(event_ts) AS first_ts FROM log GROUP BY 1),
found AS (SELECT case_id FROM sets WHERE (bought OR clicked) AND NOT failed AND CAST(first_ts AS DATE) <> DATE '2024-01-02')"""


def _found_cases(spark, d):
    log = day_log(spark, d).select("event_id", "case_id", "activity", *ORDER_KEYS, "result_code")
    root = caseindex.build(log, staged_path(spark, "case-index"), slots=16)
    wanted = caseindex.any_of("activity", ["purchase", "click"]) & ~caseindex.has("result_code", FAILED)
    return root, wanted & ~caseindex.has("started", "2024-01-02")


@query("M12_index_search", f"{_INDEXED} SELECT case_id FROM found")
def _(spark, d):
    root, wanted = _found_cases(spark, d)
    return caseindex.search(spark, root, wanted).select("case_id")


@query("F08_index_events", f"{_INDEXED} SELECT event_id, case_id, activity FROM log JOIN found USING (case_id)")
def _(spark, d):
    root, wanted = _found_cases(spark, d)
    return caseindex.events(spark, root, caseindex.search(spark, root, wanted)).select("event_id", "case_id", "activity")


@query(
    "M18_rework_with_exemptions",
    f"""WITH {DAY_LOG}, normal AS (SELECT activity FROM log GROUP BY 1 HAVING activity IN ('click', 'view')),
rework AS (SELECT DISTINCT case_id FROM (SELECT case_id, activity FROM log GROUP BY ALL HAVING count(*) >= 2)
           WHERE activity NOT IN (FROM normal))
SELECT count(*) AS rework_cases, (SELECT count(DISTINCT case_id) FROM log) AS total_cases,
  round(count(*) / (SELECT CAST(count(DISTINCT case_id) AS DOUBLE) FROM log), 6) AS rework_rate FROM rework""",
)
def _(spark, d):
    log = day_log(spark, d)
    normal = log.select("activity").filter(F.col("activity").isin("click", "view")).distinct()
    return cases.rework_rate(log, exempt=normal)


# --- failures ----------------------------------------------------------------------------------


@query(
    "M07_failure_rate_by_activity",
    f"""WITH {ORDER_LOG} SELECT activity, count(*) AS event_count, count_if(result_code = 'F') AS failed_count,
  round(count_if(result_code = 'F') / CAST(count(*) AS DOUBLE), 6) AS failure_rate FROM log GROUP BY 1""",
)
def _(spark, d):
    return cases.failure_rate_by_activity(order_log(spark, d), F.col("result_code") == "F")


@query(
    "M07_after_failure",
    f"""WITH {USER_LOG}, {STEPS} SELECT activity AS failed_activity, target AS next_activity,
  count(*) AS transition_count, count(DISTINCT case_id) AS case_count
FROM steps WHERE result_code = 'FAILED' AND target IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    return cases.after_failure(user_log(spark, d), is_failed())


_BY_OUTCOME = f"""WITH {DAY_LOG}, outcome AS (
  SELECT case_id, bool_or(result_code = 'FAILED') AS failed,
         date_diff('millisecond', min(event_ts), max(event_ts)) AS took FROM log GROUP BY 1)
SELECT failed, count(*) AS case_count, round(avg(took), 3) AS avg_throughput_ms,
  round(quantile_cont(took, 0.5), 3) AS median_throughput_ms, round(quantile_cont(took, 0.9), 3) AS p90_throughput_ms
FROM outcome GROUP BY failed"""


@query("M07_throughput_by_outcome", _BY_OUTCOME)
def _(spark, d):
    return cases.throughput_by_outcome(day_log(spark, d), is_failed())


@query("M07_throughput_by_outcome_split", _BY_OUTCOME)
def _(spark, d):
    return cases.throughput_by_outcome(day_log(spark, d), is_failed(), SPLIT)


@query(
    "M07_variants_by_outcome",
    f"""WITH {DAY_LOG}, {TRACES}, outcome AS (SELECT case_id, bool_or(result_code = 'FAILED') AS failed FROM log GROUP BY 1)
SELECT variant_hash, count_if(failed) AS failed_cases, count_if(NOT failed) AS successful_cases
FROM traces JOIN outcome USING (case_id) GROUP BY 1""",
)
def _(spark, d):
    return variants.variants_by_outcome(day_log(spark, d), is_failed())


@query(
    "M07_result_codes",
    f"""WITH {ORDER_LOG} SELECT result_code, count(*) AS event_count, count(DISTINCT case_id) AS case_count,
  round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM log), 6) AS event_share FROM log GROUP BY 1""",
)
def _(spark, d):
    return cases.result_codes(order_log(spark, d))


# --- variants ----------------------------------------------------------------------------------

_VARIANTS_TOP = f"""WITH {DAY_LOG}, {TRACES} SELECT variant_hash, any_value(seq) AS variant_sequence,
  count(*) AS case_count FROM traces GROUP BY 1 ORDER BY case_count DESC, variant_hash LIMIT 100"""


@query("A11_variants_top", _VARIANTS_TOP)
def _(spark, d):
    return variants.variants_top(day_log(spark, d))


@query("L05_variant_limit", _VARIANTS_TOP.replace("LIMIT 100", "LIMIT 10"))
def _(spark, d):
    return variants.variants_top(day_log(spark, d), limit=10)


_CASE_TRACES = f"""WITH {DAY_LOG}, {TRACES}, outcome AS (SELECT case_id, bool_or(result_code = 'FAILED') AS has_failure FROM log GROUP BY 1)
SELECT case_id, variant_hash, n AS event_count, took AS throughput_ms, rework AS has_rework, has_failure
FROM traces JOIN outcome USING (case_id)"""


@query("A11_case_traces", _CASE_TRACES)
def _(spark, d):
    return variants.case_traces(day_log(spark, d), is_failed())


@query("A11_case_traces_split", _CASE_TRACES)
def _(spark, d):
    return variants.case_traces(day_log(spark, d), is_failed(), SMALL_PIECES)


@query("A11_case_sequences", f"WITH {ORDER_LOG}, {TRACES} SELECT case_id, seq AS variant_sequence FROM traces")
def _(spark, d):
    return variants.case_sequences(order_log(spark, d))


@query(
    "A11_variant_steps",
    f"""WITH {DAY_LOG}, {TRACES}, {STEPS}, top AS (SELECT variant_hash, min(case_id) AS case_id FROM traces
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 100)
SELECT variant_hash, pos AS step, activity FROM top JOIN steps USING (case_id)""",
)
def _(spark, d):
    return variants.variant_steps(day_log(spark, d))


_VARIANT_SUMMARY = f"""WITH {DAY_LOG}, {TRACES}, outcome AS (SELECT case_id, bool_or(result_code = 'FAILED') AS failed FROM log GROUP BY 1),
summary AS (
SELECT variant_hash, count(*) AS case_count, min(case_id) AS representative_case_id, round(avg(n), 6) AS avg_event_count,
  round(avg(CAST(rework AS INT)), 6) AS rework_rate, round(avg(CAST(failed AS INT)), 6) AS failure_rate,
  round(quantile_cont(took, 0.5), 3) AS median_throughput_ms, round(quantile_cont(took, 0.9), 3) AS p90_throughput_ms,
  round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM traces), 6) AS case_share
FROM traces JOIN outcome USING (case_id) GROUP BY 1)"""


@query("M03_variant_summary", f"{_VARIANT_SUMMARY} FROM summary")
def _(spark, d):
    return variants.variant_summary(day_log(spark, d), is_failed())


@query("M03_variant_summary_split", f"{_VARIANT_SUMMARY} FROM summary")
def _(spark, d):
    return variants.variant_summary(day_log(spark, d), is_failed(), SMALL_PIECES)


@query(
    "M03_ranked_variants",
    f"""{_VARIANT_SUMMARY} SELECT *, row_number() OVER (ORDER BY case_count DESC, variant_hash) AS rank
FROM summary ORDER BY rank LIMIT 100""",
)
def _(spark, d):
    return variants.ranked_variants(day_log(spark, d), failure=is_failed())


# Beginnings spelled out: the letters of all steps so far name a node.
_TREE = f"""WITH {{log}}, {STEPS}, begun AS (
  SELECT case_id, pos, activity, target IS NULL AS is_end,
         string_agg(activity, chr(31)) OVER (PARTITION BY case_id ORDER BY pos) AS path
  FROM steps), nodes AS (
  SELECT pos AS depth, path, min(activity) AS activity, count(*) AS case_count, count_if(is_end) AS ending_cases,
         min(case_id) AS first_case_id
  FROM begun GROUP BY pos, path), tree AS (
  SELECT n.*, left(n.path, length(n.path) - length(n.activity) - 1) AS parent FROM nodes n), tree2 AS (
  SELECT t.*, coalesce(c.n, 0) AS n_children,
         t.case_count / (SELECT sum(case_count) FROM nodes WHERE depth = 1) AS case_share,
         t.case_count / coalesce(p.case_count, (SELECT sum(case_count) FROM nodes WHERE depth = 1)) AS parent_share
  FROM tree t
  LEFT JOIN (SELECT depth - 1 AS depth, parent AS path, count(*) AS n FROM tree GROUP BY ALL) c USING (depth, path)
  LEFT JOIN nodes p ON p.depth = t.depth - 1 AND p.path = t.parent)"""
_TREE_OUT = """SELECT depth, activity, case_count, CAST(ending_cases AS BIGINT) AS ending_cases, n_children,
  round(case_share, 6) AS case_share, round(parent_share, 6) AS parent_share, first_case_id FROM tree2"""
_TREE_COLUMNS = ("depth", "activity", "case_count", "ending_cases", "n_children", "case_share", "parent_share", "first_case_id")


@query("M03_variant_tree", f"{_TREE.format(log=DAY_LOG)} {_TREE_OUT}")
def _(spark, d):
    return vartree.variant_tree(day_log(spark, d)).select(*_TREE_COLUMNS)


@query("M03_variant_tree_split", f"{_TREE.format(log=USER_LOG)} {_TREE_OUT}")
def _(spark, d):
    return vartree.variant_tree(user_log(spark, d), SPLIT).select(*_TREE_COLUMNS)


@query(
    "A11_split_point_steps",
    f"""{_TREE.format(log=ORDER_LOG)}, parted AS (
  SELECT * FROM tree2 WHERE case_count >= 2 AND n_children + CASE WHEN ending_cases > 0 THEN 1 ELSE 0 END > 1)
SELECT p.depth, p.first_case_id, p.case_count, CAST(s.pos AS BIGINT) AS step, s.activity AS step_activity
FROM parted p JOIN steps s ON s.case_id = p.first_case_id AND s.pos <= p.depth""",
)
def _(spark, d):
    log = order_log(spark, d)
    parted = vartree.split_points(vartree.variant_tree(log))
    named = parted.select(*vartree.NODE, "first_case_id", "case_count")
    steps = vartree.node_steps(log, parted).join(named, list(vartree.NODE))
    return steps.select("depth", "first_case_id", "case_count", "step", "step_activity")


_COVERAGE = f"""WITH {DAY_LOG}, {TRACES}, counted AS (SELECT variant_hash, count(*) AS case_count FROM traces GROUP BY 1),
ranked AS (SELECT variant_hash, case_count, row_number() OVER r AS rank,
  case_count / sum(case_count) OVER () AS case_share,
  sum(case_count) OVER r / sum(case_count) OVER () AS cumulative_share
FROM counted WINDOW r AS (ORDER BY case_count DESC, variant_hash ROWS UNBOUNDED PRECEDING))"""


_COVERAGE_OUT = "SELECT variant_hash, case_count, rank, round(case_share, 6) AS case_share, round(cumulative_share, 6) AS cumulative_share FROM ranked"


@query("M04_variant_coverage", f"{_COVERAGE} {_COVERAGE_OUT}")
def _(spark, d):
    return variants.variant_coverage(day_log(spark, d))


@query("M04_variant_coverage_split", f"{_COVERAGE} {_COVERAGE_OUT}")
def _(spark, d):
    return variants.variant_coverage(day_log(spark, d), SMALL_PIECES)


@query(
    "M04_variant_concentration",
    f"""{_COVERAGE} SELECT count(*) AS variant_count, min(rank) FILTER (WHERE cumulative_share >= 0.8) AS variants_for_coverage,
  round(max(case_share) FILTER (WHERE rank = 1), 6) AS top_variant_share FROM ranked""",
)
def _(spark, d):
    return variants.variant_concentration(day_log(spark, d), 0.8)


# --- paths -------------------------------------------------------------------------------------

_EXACT = f"""WITH {{log}}, {STEPS}, runs AS (
  SELECT case_id, activity AS a, target AS b, lead(activity, 2) OVER (PARTITION BY case_id ORDER BY pos) AS c FROM steps)
SELECT case_id, count(*) AS occurrences FROM runs WHERE a = '{{a}}' AND b = '{{b}}' AND c = '{{c}}' GROUP BY 1"""


@query("M09_exact_path", _EXACT.format(log=USER_LOG, a="view", b="click", c="purchase"))
def _(spark, d):
    return paths.cases_with_exact_path(user_log(spark, d), ["view", "click", "purchase"])


@query("M09_exact_path_split", _EXACT.format(log=USER_LOG, a="click", b="click", c="error"))
def _(spark, d):
    return paths.cases_with_exact_path(user_log(spark, d), ["click", "click", "error"], SPLIT)


@query("M09_exact_path_conversations", _EXACT.format(log=TALK_LOG, a="user", b="assistant", c="user"))
def _(spark, d):
    return paths.cases_with_exact_path(talk_log(spark, d), ["user", "assistant", "user"])


# Labels are coded as single letters so that LIKE can express "in this order, gaps allowed".
_ORDERED_PATH = f"""WITH {DAY_LOG}, coded AS (
  SELECT case_id, string_agg(left(activity, 1), '' ORDER BY {ORDERED}) AS letters FROM log GROUP BY 1)
SELECT case_id FROM coded WHERE letters LIKE '%s%c%v%'"""


@query("M10_ordered_path", _ORDERED_PATH)
def _(spark, d):
    return paths.cases_with_ordered_path(day_log(spark, d), ["signup", "click", "view"])


@query("M10_ordered_path_split", _ORDERED_PATH)
def _(spark, d):
    return paths.cases_with_ordered_path(
        day_log(spark, d), ["signup", "click", "view"], ScalePolicy(max_group_rows=4)
    )


_RUNS = f"""WITH {{log}}, {STEPS}, runs AS (
  SELECT case_id, activity || ' > ' || target || ' > ' || lead(activity, 2) OVER (PARTITION BY case_id ORDER BY pos) AS path
  FROM steps), repeated AS (
  SELECT case_id, path, count(*) AS occurrences FROM runs WHERE path IS NOT NULL GROUP BY ALL HAVING count(*) > 1)"""


@query("M17_repeated_paths", f"{_RUNS.format(log=USER_LOG)} FROM repeated")
def _(spark, d):
    return paths.repeated_paths(user_log(spark, d), 3)


@query("M17_repeated_paths_split", f"{_RUNS.format(log=USER_LOG)} FROM repeated")
def _(spark, d):
    return paths.repeated_paths(user_log(spark, d), 3, SPLIT)


@query(
    "M17_repeated_path_ranking",
    f"""{_RUNS.format(log=DAY_LOG)} SELECT path, count(*) AS case_count, CAST(sum(occurrences) AS BIGINT) AS occurrences
FROM repeated GROUP BY 1""",
)
def _(spark, d):
    return paths.repeated_path_ranking(day_log(spark, d), 3)


_MAXIMAL = """WITH {log},
placed AS (SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY {order}) AS pos FROM log),
whole AS (SELECT case_id, list(activity ORDER BY pos) AS steps, count(*) AS n FROM placed GROUP BY 1),
begun AS (SELECT *, unnest(range(1, n + 1)) AS pos FROM whole),
parts AS (SELECT *, unnest(range(2, n - pos + 2)) AS length FROM begun),
named AS (
  SELECT case_id, length, array_to_string(steps[pos : pos + length - 1], ' > ') AS path,
    coalesce(steps[pos - 1], '^') AS before, coalesce(steps[pos + length], '$') AS after FROM parts)
SELECT case_id, path, CAST(length AS BIGINT) AS length, count(*) AS occurrences FROM named GROUP BY ALL
HAVING count(DISTINCT before) > 1 AND count(DISTINCT after) > 1"""


def _with_text(log, found):
    """Repeats with their steps as text."""
    steps = repeats.repeat_steps(log, found).withColumn("s", F.struct("step", "step_activity"))
    named = steps.groupBy("case_id", "position", "length", "occurrences").agg(F.array_sort(F.collect_list("s")).alias("s"))
    path = F.array_join(F.transform("s", lambda s: s["step_activity"]), " > ")
    return named.select("case_id", path.alias("path"), "length", "occurrences")


@query("M17_maximal_repeats", _MAXIMAL.format(log=USER_LOG, order=ORDERED))
def _(spark, d):
    log = user_log(spark, d)
    return _with_text(log, stage(repeats.maximal_repeats(log), "repeats"))


@query("M17_maximal_repeats_split", _MAXIMAL.format(log=ORDER_LOG, order=ORDERED))
def _(spark, d):
    log = order_log(spark, d)
    return _with_text(log, stage(repeats.maximal_repeats(log, policy=SPLIT), "repeats"))
