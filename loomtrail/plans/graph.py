"""Ordering, directly-follows graph and edge reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrail.model import effective_limit, MAX_EDGES, MAX_NODES
from loomtrail.operators import dfg
from loomtrail.operators.sequence import follow, transitions
from loomtrail.plans.logs import (
    DAY_LOG, EDGE_COLUMNS, EDGES, LINE_LOG, ORDER_LOG, STEPS, TALK_LOG, USER_LOG,
    day_log, line_log, order_log, talk_log, user_log,
)
from loomtrail.plans.registry import query, table, ts_text
from loomtrail.scale import ScalePolicy

# Forces the split form on the small test tables, so that the oracle checks it as well.
SPLIT = ScalePolicy(max_group_rows=60)

_USER_EDGES = f"WITH {USER_LOG}, {STEPS}, {EDGES}"
_DAY_EDGES = f"WITH {DAY_LOG}, {STEPS}, {EDGES}"

_W01 = f"""WITH {USER_LOG}, {STEPS}
SELECT event_id, case_id, activity AS source, target, {ts_text('event_ts')} AS event_ts,
       {ts_text('next_ts')} AS next_event_ts, date_diff('millisecond', event_ts, next_ts) AS transition_ms
FROM steps"""


def _steps_with_id(log, policy=None):
    followed = follow(log, policy) if policy else follow(log)
    return followed.select(
        "event_id", "case_id", F.col("activity").alias("source"), F.col("next_activity").alias("target"),
        "event_ts", "next_event_ts", _ms().alias("transition_ms"),
    )


def _ms():
    from loomtrail.functions.timing import millis_between

    return millis_between(F.col("event_ts"), F.col("next_event_ts"))


@query("W01_next_event", _W01)
def _(spark, d):
    return _steps_with_id(user_log(spark, d))


@query("W01_next_event_split", _W01)
def _(spark, d):
    return _steps_with_id(user_log(spark, d), SPLIT)


@query(
    "W01_next_event_by_sequence",
    f"""WITH {LINE_LOG}, {STEPS}
SELECT case_id, activity AS source, target, date_diff('millisecond', event_ts, next_ts) AS transition_ms,
       count(*) AS transition_count
FROM steps WHERE target IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    return (
        transitions(line_log(spark, d))
        .filter(F.col("target").isNotNull())
        .groupBy("case_id", "source", "target", "transition_ms")
        .agg(F.count("*").alias("transition_count"))
    )


_W02 = f"""WITH {ORDER_LOG}, {STEPS}
SELECT event_id, case_id, activity, {ts_text('event_ts')} AS event_ts, pos AS event_position,
       target AS next_activity, {ts_text('next_ts')} AS next_event_ts
FROM steps"""
_W02_COLUMNS = ("event_id", "case_id", "activity", "event_ts", "event_position", "next_activity", "next_event_ts")


@query("W02_ordered_events", _W02)
def _(spark, d):
    return follow(order_log(spark, d), position=True).select(*_W02_COLUMNS)


@query("W02_ordered_events_split", _W02)
def _(spark, d):
    policy = ScalePolicy(max_group_rows=12)
    return follow(order_log(spark, d), policy, position=True).select(*_W02_COLUMNS)


@query(
    "W04_transition_time",
    f"""WITH {ORDER_LOG}, {STEPS}
SELECT case_id, activity AS source, target, pos AS event_position,
       date_diff('millisecond', event_ts, next_ts) AS transition_ms
FROM steps WHERE target IS NOT NULL""",
)
def _(spark, d):
    return (
        follow(order_log(spark, d), position=True)
        .filter(F.col("next_activity").isNotNull())
        .select("case_id", F.col("activity").alias("source"), F.col("next_activity").alias("target"),
                "event_position", _ms().alias("transition_ms"))
    )


@query(
    "A01_log_totals",
    f"WITH {USER_LOG} SELECT count(DISTINCT case_id) AS total_cases, count(*) AS total_events FROM log",
)
def _(spark, d):
    return dfg.log_totals(user_log(spark, d))


_NODES = f"""WITH {USER_LOG}
SELECT activity, count(*) AS event_count, count(DISTINCT case_id) AS case_count,
       round(count(DISTINCT case_id) / (SELECT CAST(count(DISTINCT case_id) AS DOUBLE) FROM log), 6) AS case_share
FROM log GROUP BY activity"""


@query("A02_dfg_nodes", _NODES)
def _(spark, d):
    return dfg.dfg_nodes(user_log(spark, d))


@query("A03_dfg_edges", f"{_USER_EDGES} SELECT {EDGE_COLUMNS} FROM edges")
def _(spark, d):
    return dfg.dfg_edges(user_log(spark, d))


@query("A03_dfg_edges_split", f"{_USER_EDGES} SELECT {EDGE_COLUMNS} FROM edges")
def _(spark, d):
    return dfg.dfg_edges(user_log(spark, d), policy=SPLIT)


@query("A03_dfg_edges_orders", f"WITH {ORDER_LOG}, {STEPS}, {EDGES} SELECT {EDGE_COLUMNS} FROM edges")
def _(spark, d):
    return dfg.dfg_edges(order_log(spark, d))


@query("A03_dfg_edges_lines", f"WITH {LINE_LOG}, {STEPS}, {EDGES} SELECT {EDGE_COLUMNS} FROM edges")
def _(spark, d):
    return dfg.dfg_edges(line_log(spark, d))


@query("A03_dfg_edges_conversations", f"WITH {TALK_LOG}, {STEPS}, {EDGES} SELECT {EDGE_COLUMNS} FROM edges")
def _(spark, d):
    return dfg.dfg_edges(talk_log(spark, d))


@query(
    "A04_dfg_result",
    f"""{_USER_EDGES}
SELECT count(DISTINCT case_id) AS total_cases, count(*) AS total_events,
       count(DISTINCT activity) AS node_count, (SELECT count(*) FROM edges) AS edge_count
FROM log""",
)
def _(spark, d):
    return dfg.dfg_summary(dfg.directly_follows(user_log(spark, d)))


@query(
    "A12_dfg_template",
    f"""{_DAY_EDGES} SELECT source AS source_activity, target AS target_activity, transition_count, case_count,
  round(median_transition_ms, 3) AS median_transition_ms, round(p90_transition_ms, 3) AS p90_transition_ms
FROM edges""",
)
def _(spark, d):
    return dfg.edge_metrics(transitions(day_log(spark, d))).withColumnsRenamed(
        {"source": "source_activity", "target": "target_activity"}
    )


@query("J04_node_share", _NODES)
def _(spark, d):
    return dfg.dfg_nodes(user_log(spark, d))


_TOP3 = "top AS (SELECT activity FROM log GROUP BY activity ORDER BY count(*) DESC, activity LIMIT 3)"


@query(
    "J03_visible_edges",
    f"{_USER_EDGES}, {_TOP3} SELECT {EDGE_COLUMNS} FROM edges"
    " WHERE EXISTS (FROM top WHERE top.activity = source) AND EXISTS (FROM top WHERE top.activity = target)",
)
def _(spark, d):
    return dfg.dfg_edges(user_log(spark, d), max_nodes=3)


@query("L01_top_nodes", f"{_NODES} ORDER BY event_count DESC, activity LIMIT 3")
def _(spark, d):
    return dfg.dfg_nodes(user_log(spark, d), max_nodes=3)


@query(
    "L02_top_edges",
    f"{_USER_EDGES} SELECT {EDGE_COLUMNS} FROM edges ORDER BY edges.transition_count DESC, source, target LIMIT 7",
)
def _(spark, d):
    return dfg.dfg_edges(user_log(spark, d), max_edges=7)


@query(
    "L03_effective_limits",
    f"{_USER_EDGES} SELECT {EDGE_COLUMNS} FROM edges ORDER BY edges.transition_count DESC, source, target LIMIT 300",
)
def _(spark, d):
    return dfg.dfg_edges(
        user_log(spark, d),
        max_nodes=effective_limit(5_000, MAX_NODES),
        max_edges=effective_limit(None, MAX_EDGES),
    )


_PART_LOG = "log AS (SELECT l_orderkey AS case_id, 'part ' || CAST(l_partkey AS VARCHAR) AS activity FROM lineitem)"


@query(
    "L03_cap_binds",
    f"""WITH {_PART_LOG} SELECT activity, count(*) AS event_count, count(DISTINCT case_id) AS case_count FROM log
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {MAX_NODES}""",
)
def _(spark, d):
    """More activities than a graph may show: what was asked for gives way to the cap."""
    part = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    log = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), part.alias("activity"))
    return dfg.dfg_nodes(log, effective_limit(1_000_000, MAX_NODES)).drop("case_share")


@query(
    "L04_limits_reached",
    f"""{_USER_EDGES}
SELECT least(count(DISTINCT activity), 2) >= 2 AS node_limit_reached, (SELECT count(*) FROM edges) >= 3 AS edge_limit_reached,
       least(count(DISTINCT activity), 2) AS node_count, (SELECT least(count(*), 3) FROM edges
        WHERE source IN (SELECT activity FROM log GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)
          AND target IN (SELECT activity FROM log GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)) AS edge_count
FROM log""",
)
def _(spark, d):
    graph = dfg.directly_follows(user_log(spark, d), max_nodes=2, max_edges=3)
    return dfg.limit_warnings(graph, max_nodes=2, max_edges=3)


@query(
    "L04_limit_warnings",
    f"""{_USER_EDGES}
SELECT count(DISTINCT activity) >= 4 AS node_limit_reached,
       (SELECT least(count(*), 300) FROM edges) >= 300 AS edge_limit_reached,
       least(count(DISTINCT activity), 4) AS node_count,
       (SELECT count(*) FROM edges
        WHERE source IN (SELECT activity FROM log GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4)
          AND target IN (SELECT activity FROM log GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4)) AS edge_count
FROM log""",
)
def _(spark, d):
    graph = dfg.directly_follows(user_log(spark, d), max_nodes=4, max_edges=300)
    return dfg.limit_warnings(graph, max_nodes=4, max_edges=None)


@query("F05_frequent_edges", f"{_USER_EDGES} SELECT {EDGE_COLUMNS} FROM edges WHERE transition_count >= 400")
def _(spark, d):
    return dfg.frequent_edges(dfg.dfg_edges(user_log(spark, d)), 400)


@query("F09_min_case_share", f"{_DAY_EDGES} SELECT {EDGE_COLUMNS} FROM edges WHERE edges.case_share >= 0.06")
def _(spark, d):
    return dfg.shared_edges(dfg.dfg_edges(day_log(spark, d)), 0.06)


@query("F10_hide_self_loops", f"{_USER_EDGES} SELECT {EDGE_COLUMNS} FROM edges WHERE source <> target")
def _(spark, d):
    return dfg.without_self_loops(dfg.dfg_edges(user_log(spark, d)))


@query("M05_self_loops", f"{_USER_EDGES} SELECT {EDGE_COLUMNS} FROM edges WHERE source = target")
def _(spark, d):
    return dfg.self_loops(dfg.dfg_edges(user_log(spark, d)))


@query(
    "M06_bottlenecks",
    f"""{_USER_EDGES} SELECT {EDGE_COLUMNS},
  round(edges.median_transition_ms / max(edges.median_transition_ms) OVER ()
        * (edges.transition_count / CAST(max(edges.transition_count) OVER () AS DOUBLE)), 6) AS score
FROM edges""",
)
def _(spark, d):
    return dfg.bottlenecks(dfg.dfg_edges(user_log(spark, d)))


@query("M19_low_support", f"{_DAY_EDGES} SELECT {EDGE_COLUMNS}, edges.case_count < 250 AS low_support FROM edges")
def _(spark, d):
    return dfg.low_support(dfg.dfg_edges(day_log(spark, d)), 250)


for _mode, _weight in (
    ("frequency", "CAST(transition_count AS DOUBLE)"),
    ("performance", "round(median_transition_ms, 6)"),
    ("case_share", "round(case_share, 6)"),
):

    def _weighted(spark, d, mode=_mode):
        return dfg.weighted_edges(dfg.dfg_edges(user_log(spark, d)), mode)

    query(f"M23_weight_{_mode}", f"{_USER_EDGES} SELECT source, target, {_weight} AS weight FROM edges")(_weighted)
