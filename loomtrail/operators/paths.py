"""Path search and repeated paths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrail.operators.sequence import SEQUENCE_COLUMNS, event_order, follow, order_value, piece_bounds, split_cases
from loomtrail.operators.variants import GATHERED_CASE_ROWS
from loomtrail.scale import DEFAULT_POLICY, ScalePolicy


def exact_path_occurrences(log: DataFrame, path: Sequence[str], policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Every place where ``path`` occurs without a gap: ``case_id, start_position``.

    Each event votes for the starts it could belong to (at most one vote per step of the path that
    carries its activity); a start with a vote for every step is an occurrence. Grouping is by
    (case, start), so a large case stays spread out.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(a).alias("label")) for i, a in enumerate(path)])
    placed = follow(log.select(*SEQUENCE_COLUMNS), policy, position=True)
    votes = (
        placed.filter(F.col("activity").isin(*set(path)))
        .select("case_id", "activity", "event_position", F.explode(steps).alias("s"))
        .filter(F.col("s.label") == F.col("activity"))
        .select("case_id", (F.col("event_position") - F.col("s.step")).alias("start_position"))
    )
    return (
        votes.groupBy("case_id", "start_position")
        .agg(F.count("*").alias("_votes"))
        .filter(F.col("_votes") == len(path))
        .drop("_votes")
    )


def cases_with_exact_path(log: DataFrame, path: Sequence[str], policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Cases that contain ``path`` as consecutive events, with the number of occurrences."""
    return (
        exact_path_occurrences(log, path, policy)
        .groupBy("case_id")
        .agg(F.count("*").alias("occurrences"))
    )


def _advance(path: Sequence[str], activities: Column, start: Column) -> Column:
    """How many steps of ``path`` are done after reading ``activities``, from ``start`` steps."""
    steps = F.array(*[F.lit(a) for a in path])
    return F.aggregate(
        activities, start, lambda done, a: F.when(F.get(steps, done) == a, done + 1).otherwise(done)
    )


def cases_with_ordered_path(log: DataFrame, path: Sequence[str], policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Cases in which the steps of ``path`` occur in this order, gaps allowed.

    A piece of a large case is summarised by where it leads from each possible start; the few
    summaries of a case are then applied one after another.
    """
    relevant = log.select(*SEQUENCE_COLUMNS).filter(F.col("activity").isin(*set(path)))
    bound = min(policy.max_group_rows, GATHERED_CASE_ROWS)
    split = split_cases(relevant, replace(policy, max_group_rows=bound))
    rows = F.array_sort(F.collect_list(F.struct(order_value().alias("o"), F.col("activity"))))
    labels = F.transform(rows, lambda r: r["activity"])
    found = (
        split.whole.groupBy("case_id")
        .agg(labels.alias("labels"))
        .filter(_advance(path, F.col("labels"), F.lit(0)) == len(path))
        .select("case_id")
    )
    if split.pieces is None:
        return found
    leads = F.array(*[_advance(path, F.col("labels"), F.lit(i)) for i in range(len(path) + 1)])
    summaries = (
        split.pieces.groupBy("case_id", "piece")
        .agg(labels.alias("labels"))
        .select("case_id", "piece", leads.alias("leads"))
    )
    chained = F.aggregate(
        F.array_sort(F.collect_list(F.struct("piece", "leads"))),
        F.lit(0),
        lambda done, p: F.get(p["leads"], done),
    )
    large = (
        summaries.groupBy("case_id").agg(chained.alias("done")).filter(F.col("done") == len(path)).select("case_id")
    )
    return found.unionByName(large)


def path_occurrences(log: DataFrame, length: int, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Every run of ``length`` consecutive activities: ``case_id, start_position, path`` (array).

    The window that orders a case also looks ahead. Of a case cut into pieces only the first and last ``length - 1``
    events of a piece meet those of its neighbours.
    """
    split = split_cases(log.select(*SEQUENCE_COLUMNS), policy)

    def ahead(over: W) -> Column:
        return F.array(*[F.lead(F.struct("activity"), i).over(over) if i else F.struct("activity") for i in range(length)])

    in_case = W.partitionBy("case_id").orderBy(*event_order())
    whole = split.whole.select("case_id", F.row_number().over(in_case).cast("bigint").alias("start_position"), ahead(in_case).alias("run"))
    if split.pieces is not None:
        in_piece = W.partitionBy("case_id", "piece").orderBy(*event_order())
        bounds = piece_bounds(split.pieces).select("case_id", "piece", "rows_before")
        placed = split.pieces.select(
            "case_id", "piece", "activity", F.row_number().over(in_piece).alias("at"), ahead(in_piece).alias("run")
        ).join(bounds, ["case_id", "piece"]).withColumn("start_position", (F.col("rows_before") + F.col("at")).cast("bigint"))
        edge = placed.where((F.col("at") < length) | F.get("run", F.lit(length - 1)).isNull())
        shared = edge.select(
            "case_id", "piece", "activity", "start_position", F.explode(F.array(*[F.lit(i) for i in range(length)])).alias("step")
        )
        # A group holds at most ``length`` rows; runs within a piece are known already.
        crossing = (
            shared.groupBy("case_id", (F.col("start_position") - F.col("step")).alias("start_position"))
            .agg(F.array_sort(F.collect_list(F.struct("step", "activity"))).alias("rows"), F.min("piece").alias("a"), F.max("piece").alias("b"))
            .where((F.size("rows") == length) & (F.col("a") < F.col("b")))
            .select("case_id", "start_position", F.transform("rows", lambda r: F.struct(r["activity"].alias("activity"))).alias("run"))
        )
        whole = whole.unionByName(placed.select("case_id", "start_position", "run")).unionByName(crossing)
    complete = whole.where(F.get("run", F.lit(length - 1)).isNotNull())
    return complete.select("case_id", "start_position", F.transform("run", lambda r: r["activity"]).alias("path"))


def _repeated(log: DataFrame, length: int, policy: ScalePolicy) -> DataFrame:
    return (
        path_occurrences(log, length, policy)
        .groupBy("case_id", "path")
        .agg(F.count("*").alias("occurrences"))
        .filter(F.col("occurrences") > 1)
    )


def repeated_paths(log: DataFrame, length: int, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Paths that occur more than once within a case: ``case_id, path, occurrences``.

    Paths are told apart by their steps; the text is for display.
    """
    return _repeated(log, length, policy).withColumn("path", F.array_join("path", " > "))


def repeated_path_ranking(log: DataFrame, length: int, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    return (
        _repeated(log, length, policy)
        .groupBy("path")
        .agg(F.count("*").alias("case_count"), F.sum("occurrences").alias("occurrences"))
        .withColumn("path", F.array_join("path", " > "))
        .orderBy(F.desc("case_count"), "path")
    )
