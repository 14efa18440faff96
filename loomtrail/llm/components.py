"""Connected components by passing smallest labels on; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrail.scale import stage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _round(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Take the smallest label next to a node or to those it is the label of, then the label of that label.

    So what has no smaller label beside itself is hooked by its followers, and chains in any order settle fast.
    ``labels`` is a written table, and so is each step that is used twice: plans stay small.
    """
    seen = edges.join(labels.toDF("v", "seen"), "v").groupBy("u").agg(F.min("seen").alias("seen"))
    beside = stage(labels.join(seen, F.col("node") == F.col("u")).select("node", "component", "seen"), "components")
    hooks = beside.groupBy(F.col("component").alias("root")).agg(F.min("seen").alias("hook"))
    lower = stage(beside.join(hooks, F.col("node") == F.col("root"), "left").select(
        "node", F.least("component", "seen", "hook").alias("component"), F.col("component").alias("before")
    ), "components")
    jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
    return lower.join(jump, "component").select("node", F.col("further").alias("component"), "before")


def _start(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low")).select(
        F.col("u").alias("node"), F.least("u", "low").alias("component")
    )


def spread(links: DataFrame, rounds: int = 2) -> DataFrame:
    """Labels after a few rounds: nodes with one label are connected, but not the reverse."""
    edges = _both_ways(links)
    labels = stage(_start(edges), "components")
    for _ in range(rounds):
        labels = stage(_round(edges, labels).select("node", "component"), "components")
    return labels


def connected(links: DataFrame) -> DataFrame:
    """Nodes of the links (a, b) with the smallest node of their component; ``links`` is a written table.

    Labels only fall, so the rounds end by themselves; none changes a label only if all links join equal ones.
    """
    edges = _both_ways(links)
    labels = stage(_start(edges), "components")
    while True:
        after = stage(_round(edges, labels), "components")
        labels = after.select("node", "component")
        if after.where("component <> before").isEmpty():
            return labels
