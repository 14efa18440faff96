"""Variants as a tree of common beginnings.

A node is a beginning shared by cases: its depth and its last activity, the cases that pass and those that
end there. Nodes are named by two 64-bit words: the exclusive or of the hashes of all steps so far, each hashed
with its place. One running word per lane therefore names every beginning of a case within the window that orders
it; a case that is cut into pieces adds the words of the pieces before. No case is ever gathered, and a missing
activity is a step of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrail.functions.timing import ratio
from loomtrail.operators.sequence import SEQUENCE_COLUMNS, event_order, piece_bounds, split_cases
from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, stage

LANES = (0x5EED, 0xC0FFEE)
#: What names a node.
NODE = ("depth", "word_1", "word_2")
PARENT = ("parent_word_1", "parent_word_2")


def _steps(place: Column) -> list[Column]:
    activity = F.col("activity")
    return [
        F.xxhash64(F.lit(seed), activity.isNull(), activity, place).alias(f"step_{k}") for k, seed in enumerate(LANES, 1)
    ]


def case_beginnings(log: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Per event the node its case has reached: ``case_id, activity, depth``, words of node and parent, ``is_end``."""
    split = split_cases(log.select(*SEQUENCE_COLUMNS), policy)
    in_case = W.partitionBy("case_id").orderBy(*event_order())
    running = in_case.rowsBetween(W.unboundedPreceding, W.currentRow)
    words = [f"word_{k}" for k in (1, 2)]
    out = ["case_id", "activity", "depth", *words, "is_end"]

    def named(df: DataFrame) -> DataFrame:
        parents = [F.col(f"word_{k}").bitwiseXOR(F.col(f"step_{k}")).alias(p) for k, p in enumerate(PARENT, 1)]
        return df.select(*out, *parents)

    at = split.whole.select(
        *SEQUENCE_COLUMNS,
        F.row_number().over(in_case).cast("bigint").alias("depth"),
        F.lead(F.lit(True)).over(in_case).isNull().alias("is_end"),
    )
    at = at.select("*", *_steps(F.col("depth")))
    whole = named(at.select("*", *[F.bit_xor(f"step_{k}").over(running).alias(f"word_{k}") for k in (1, 2)]))
    if split.pieces is None:
        return whole
    in_piece = W.partitionBy("case_id", "piece").orderBy(*event_order())
    # Both joins follow a window over their keys, which has dealt and sorted the pieces already.
    bounds = piece_bounds(split.pieces)
    at = (
        split.pieces.withColumn("at", F.row_number().over(in_piece))
        .withColumn("inside", F.lead(F.lit(True)).over(in_piece))
        .join(bounds, ["case_id", "piece"])
        .withColumn("depth", (F.col("rows_before") + F.col("at")).cast("bigint"))
        .withColumn("is_end", F.col("inside").isNull() & F.col("next_head").isNull())
    )
    at = stage(at.select(*SEQUENCE_COLUMNS, "piece", "depth", "is_end", *_steps(F.col("depth"))), "piece-steps")
    # One row per piece and case, so the window sees at most as many rows as there are pieces.
    before = W.partitionBy("case_id").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    totals = at.groupBy("case_id", "piece").agg(*[F.bit_xor(f"step_{k}").alias(f"total_{k}") for k in (1, 2)])
    offsets = totals.select(
        "case_id", "piece", *[F.coalesce(F.bit_xor(f"total_{k}").over(before), F.lit(0)).alias(f"before_{k}") for k in (1, 2)]
    )
    running = in_piece.rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = (
        at.select("*", *[F.bit_xor(f"step_{k}").over(running).alias(f"own_{k}") for k in (1, 2)])
        .join(offsets, ["case_id", "piece"])
        .select("*", *[F.col(f"own_{k}").bitwiseXOR(F.col(f"before_{k}")).alias(f"word_{k}") for k in (1, 2)])
    )
    return whole.unionByName(named(pieces))


def variant_tree(log: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """One row per node: its name, ``activity, case_count, ending_cases, n_children, case_share`` (of all cases),
    ``parent_share`` (of the cases of its parent) and ``first_case_id``, the smallest case that passes.

    A node that cases end in is a variant; ``ending_cases`` is its number of cases. Cases are counted before the
    shuffle, so nodes near the root may hold any share of them.
    """
    nodes = stage(
        case_beginnings(log, policy)
        .groupBy(*NODE)
        .agg(
            F.min("activity").alias("activity"),
            *[F.min(p).alias(p) for p in PARENT],
            F.count("*").alias("case_count"),
            F.count_if("is_end").alias("ending_cases"),
            F.min("case_id").alias("first_case_id"),
        ),
        "variant-nodes",
    )
    n_cases = nodes.where("depth = 1").agg(F.sum("case_count").alias("n")).scalar()
    # A node can have as many children as there are activities; they are counted before the shuffle.
    children = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), *[
        F.col(p).alias(w) for p, w in zip(PARENT, NODE[1:])]).agg(F.count("*").alias("n_children"))
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), *[F.col(w).alias(p) for p, w in zip(PARENT, NODE[1:])],
        F.col("case_count").alias("parent_cases"),
    )
    return (
        nodes.join(children, list(NODE), "left")
        .join(above, ["depth", *PARENT], "left")
        .select(
            *NODE, *PARENT, "activity", "case_count", "ending_cases",
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            ratio(F.col("case_count"), n_cases).alias("case_share"),
            ratio(F.col("case_count"), F.coalesce("parent_cases", n_cases)).alias("parent_share"),
            "first_case_id",
        )
    )


def node_steps(log: DataFrame, nodes: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """The activities along the paths to ``nodes``, one row per step: name of the node, ``step, step_activity``.

    Steps are read from the first case of each node, and only such cases are ordered.
    """
    wanted = nodes.select(*NODE, F.col("first_case_id").alias("case_id"))
    cases = log.join(wanted.select("case_id").distinct(), "case_id", "left_semi")
    steps = case_beginnings(cases, policy).select("case_id", F.col("depth").alias("step"), F.col("activity").alias("step_activity"))
    return steps.join(wanted, "case_id").where(F.col("step") <= F.col("depth")).select(*NODE, "step", "step_activity")


def split_points(tree: DataFrame, least_cases: int = 2) -> DataFrame:
    """Nodes where ways part: more than one way on (children, or an end among cases that go on)."""
    ways = F.col("n_children") + (F.col("ending_cases") > 0).cast("bigint")
    return tree.where((F.col("case_count") >= least_cases) & (ways > 1)).withColumn("n_ways", ways)
