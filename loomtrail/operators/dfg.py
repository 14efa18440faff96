"""Directly-follows graph: totals, nodes and edges."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from loomtrail.functions.quantiles import quantiles
from loomtrail.functions.timing import ratio
from loomtrail.model import MAX_EDGES, MAX_NODES, effective_limit
from loomtrail.operators.sequence import transitions
from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, broadcast_checked, stage

EDGE_QUANTILES = {"median_transition_ms": 0.5, "p90_transition_ms": 0.9}


@dataclass(frozen=True)
class DirectlyFollowsGraph:
    totals: DataFrame
    nodes: DataFrame
    edges: DataFrame

    def fetch(self) -> dict[str, list[Row]]:
        """Rows of the three reports, run as concurrent jobs, within the display limits."""
        reports = {"totals": self.totals, "nodes": self.nodes, "edges": self.edges}
        with ThreadPoolExecutor(len(reports)) as pool:
            limits = {"totals": 1, "nodes": MAX_NODES, "edges": MAX_EDGES}
            return dict(zip(reports, pool.map(lambda name: reports[name].take(limits[name]), reports)))


def log_totals(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count_distinct("case_id").alias("total_cases"), F.count("*").alias("total_events")
    )


def case_total(log: DataFrame):
    """Number of cases as a scalar subquery: computed once, no join in the plan that uses it."""
    return log.agg(F.count_distinct("case_id").alias("total_cases")).scalar()


def dfg_nodes(log: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Activities with event count, case count and share of cases, most frequent first."""
    nodes = (
        log.groupBy("activity")
        .agg(F.count("*").alias("event_count"), F.count_distinct("case_id").alias("case_count"))
        .withColumn("case_share", ratio(F.col("case_count"), case_total(log)))
        .orderBy(F.desc("event_count"), "activity")
    )
    return nodes if max_nodes is None else nodes.limit(max_nodes)


def top_activities(log: DataFrame, max_nodes: int) -> DataFrame:
    return (
        log.groupBy("activity")
        .agg(F.count("*").alias("event_count"))
        .orderBy(F.desc("event_count"), "activity")
        .limit(max_nodes)
        .select("activity")
    )


def edge_metrics(
    steps: DataFrame, policy: ScalePolicy = DEFAULT_POLICY, staged: bool = False
) -> DataFrame:
    """Count, cases and exact quantiles per (source, target); ``steps`` as ``transitions`` gives.

    Cases are counted in a branch of their own: a distinct count next to quantiles would carry a
    quantile buffer per case. Pass ``staged`` when ``steps`` is a table already.
    """
    pairs = steps.select("case_id", "source", "target", "transition_ms")
    pairs = (pairs if staged else stage(pairs, "transitions")).filter(F.col("target").isNotNull())
    counted = (
        pairs.groupBy("case_id", "source", "target")
        .agg(F.count("*").alias("_n"))
        .groupBy("source", "target")
        .agg(F.sum("_n").alias("transition_count"), F.count("*").alias("case_count"))
    )
    # One row per edge, counted once: it also tells the largest group.
    counted = stage(counted, "edge-counts")
    largest = counted.agg(F.max("transition_count")).first()[0] or 0
    spread = quantiles(pairs, ["source", "target"], "transition_ms", EDGE_QUANTILES, policy, staged=True, largest=largest)
    return counted.join(spread, ["source", "target"])


def dfg_edges(
    log: DataFrame,
    max_nodes: int | None = None,
    max_edges: int | None = None,
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Directly-follows pairs. A node limit hides edges; it never bridges over hidden nodes."""
    steps = transitions(log, policy).select("case_id", "source", "target", "transition_ms")
    steps = stage(steps, "transitions")
    # Every case has exactly one event without a target.
    last = steps.filter(F.col("target").isNull()).agg(F.count("*").alias("n")).scalar()
    edges = edge_metrics(steps, policy, staged=True).withColumn("case_share", ratio(F.col("case_count"), last))
    if max_nodes is not None:
        # The limit bounds this side.
        named = steps.select(F.col("source").alias("activity"))
        visible = broadcast_checked(top_activities(named, effective_limit(max_nodes, MAX_NODES)), policy)
        for end in ("source", "target"):
            edges = edges.join(visible.withColumnRenamed("activity", end), end, "left_semi")
    edges = edges.select(
        "source",
        "target",
        "transition_count",
        "case_count",
        "case_share",
        *EDGE_QUANTILES,
    ).orderBy(F.desc("transition_count"), "source", "target")
    return edges if max_edges is None else edges.limit(max_edges)


def directly_follows(
    log: DataFrame,
    max_nodes: int | None = None,
    max_edges: int | None = None,
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DirectlyFollowsGraph:
    return DirectlyFollowsGraph(
        totals=log_totals(log),
        nodes=dfg_nodes(log, max_nodes),
        edges=dfg_edges(log, max_nodes, max_edges, policy),
    )


def dfg_summary(graph: DirectlyFollowsGraph) -> DataFrame:
    """One row: totals of the log and number of nodes and edges returned."""
    n_nodes = graph.nodes.agg(F.count("*").alias("n")).scalar()
    n_edges = graph.edges.agg(F.count("*").alias("n")).scalar()
    return graph.totals.select(
        "total_cases", "total_events", n_nodes.alias("node_count"), n_edges.alias("edge_count")
    )


def limit_warnings(
    graph: DirectlyFollowsGraph, max_nodes: int | None = None, max_edges: int | None = None
) -> DataFrame:
    """Tell which display limits the returned graph has reached."""
    counts = dfg_summary(graph)
    return counts.select(
        (F.col("node_count") >= effective_limit(max_nodes, MAX_NODES)).alias("node_limit_reached"),
        (F.col("edge_count") >= effective_limit(max_edges, MAX_EDGES)).alias("edge_limit_reached"),
        "node_count",
        "edge_count",
    )


def frequent_edges(edges: DataFrame, min_count: int) -> DataFrame:
    """Minimum transition frequency; nodes are not affected."""
    return edges.filter(F.col("transition_count") >= min_count)


def shared_edges(edges: DataFrame, min_share: float) -> DataFrame:
    return edges.filter(F.col("case_share") >= min_share)


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("source") != F.col("target"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("source") == F.col("target")).orderBy(
        F.desc("transition_count"), "source"
    )


def weighted_edges(edges: DataFrame, mode: str) -> DataFrame:
    """One ``weight`` per edge: by frequency, by performance (median time) or by case share."""
    weights = {
        "frequency": F.col("transition_count").cast("double"),
        "performance": F.col("median_transition_ms"),
        "case_share": F.col("case_share"),
    }
    if mode not in weights:
        raise ValueError(f"mode must be one of {sorted(weights)}")
    return edges.select("source", "target", weights[mode].alias("weight"))


def bottlenecks(edges: DataFrame) -> DataFrame:
    """Slow and frequent transitions. The score only sorts; the measures stay visible.

    score = share of the largest median x share of the largest frequency.
    """
    tops = edges.agg(
        F.max("median_transition_ms").alias("m"), F.max("transition_count").alias("c")
    )
    top_median = tops.select("m").scalar()
    top_count = tops.select("c").scalar()
    return edges.withColumn(
        "score",
        ratio(F.col("median_transition_ms"), top_median) * ratio(F.col("transition_count"), top_count),
    ).orderBy(F.desc("score"), "source", "target")


def low_support(edges: DataFrame, min_cases: int) -> DataFrame:
    return edges.withColumn("low_support", F.col("case_count") < min_cases)
