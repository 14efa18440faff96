"""Deterministic order of the events of a case, and what follows what.

A case can be so large that one task must not sort it. ``CaseSplit`` separates the log into
cases that fit a task and pieces of cases that do not. The rows of the latter go through a range shuffle over
(case, order keys) and are sorted on disk where they arrive; pieces are cut from the sorted rows by counting, so they follow
each other in event order even when all timestamps are equal. They are written to the shared folder so that every
reader sees the same cut. Many pieces share a task, so the number of tasks follows the rows and not the bound of a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrail.functions.timing import millis_between
from loomtrail.model import ORDER_KEYS
from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, broadcast_checked, stage


def event_order() -> list[Column]:
    return [F.col(k).asc_nulls_last() for k in ORDER_KEYS]


def order_value() -> Column:
    """The event order as one comparable value (missing keys last)."""
    return F.struct(*[part for k in ORDER_KEYS for part in (F.col(k).isNull(), F.col(k))])


#: Rows that a task of the range shuffle gets at least; the sort spills, so nothing depends on them but the number of tasks.
SORTED_ROWS = 250_000
#: ``monotonically_increasing_id`` keeps the place in a partition in its low bits.
_PLACE_BITS = 33


@dataclass(frozen=True)
class CaseSplit:
    """``whole``: rows of cases that fit a task. ``pieces``: the other rows, with ``piece``."""

    whole: DataFrame
    pieces: DataFrame | None


def split_cases(log: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> CaseSplit:
    sizes = log.groupBy("case_id").agg(F.count("*").alias("case_rows"))
    if (sizes.agg(F.max("case_rows")).first()[0] or 0) <= policy.max_group_rows:
        return CaseSplit(log, None)
    # At most rows / max_group_rows cases can be this large.
    large = stage(sizes.filter(F.col("case_rows") > policy.max_group_rows), "large-cases")
    n_rows, n_cases = large.agg(F.sum("case_rows"), F.count("*")).first()
    keys = broadcast_checked(large.select("case_id"), policy, rows=n_cases)
    order = [F.col("case_id").asc(), *event_order()]
    tasks = -(-n_rows // max(policy.max_group_rows, SORTED_ROWS)) + 1
    cut = (
        log.join(keys, "case_id", "left_semi")
        .repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftleft(F.shiftright("_at", _PLACE_BITS), _PLACE_BITS))
        .withColumn("piece", F.col("_part") + F.expr(f"(_at - _part) div {policy.max_group_rows}"))
        .drop("_at", "_part")
    )
    return CaseSplit(log.join(keys, "case_id", "left_anti"), stage(cut, "case-pieces"))


def piece_bounds(pieces: DataFrame) -> DataFrame:
    """Per piece: the first event of the following piece and the number of events before it.

    One row per piece and case, so the window below sees at most as many rows as there are pieces.
    """
    heads = pieces.groupBy("case_id", "piece").agg(
        F.min_by(F.struct("activity", "event_ts"), order_value()).alias("head"),
        F.count("*").alias("piece_rows"),
    )
    along = W.partitionBy("case_id").orderBy("piece")
    return heads.select(
        "case_id",
        "piece",
        F.lead("head").over(along).alias("next_head"),
        F.coalesce(
            F.sum("piece_rows").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("rows_before"),
    )


def follow(log: DataFrame, policy: ScalePolicy = DEFAULT_POLICY, position: bool = False) -> DataFrame:
    """Add ``next_activity`` and ``next_event_ts`` (and ``event_position``, from 1) to every event."""
    return follow_split(split_cases(log, policy), policy, position)


def follow_split(split: CaseSplit, policy: ScalePolicy = DEFAULT_POLICY, position: bool = False) -> DataFrame:
    """``follow`` for a log that has been split already."""
    columns = [c for c in split.whole.columns if c != "piece"]
    in_case = W.partitionBy("case_id").orderBy(*event_order())
    whole = split.whole.select(
        *columns,
        F.lead("activity").over(in_case).alias("next_activity"),
        F.lead("event_ts").over(in_case).alias("next_event_ts"),
        *([F.row_number().over(in_case).cast("bigint").alias("event_position")] if position else []),
    )
    if split.pieces is None:
        return whole
    in_piece = W.partitionBy("case_id", "piece").orderBy(*event_order())
    # The window has dealt and sorted the pieces by the keys of this join; the bounds follow them.
    bounds = piece_bounds(split.pieces)
    stitched = (
        split.pieces.withColumn("in_next", F.lead(F.struct("activity", "event_ts")).over(in_piece))
        .withColumn("in_position", F.row_number().over(in_piece))
        .join(bounds, ["case_id", "piece"])
        .withColumn("after", F.coalesce("in_next", "next_head"))
        .select(
            *columns,
            F.col("after.activity").alias("next_activity"),
            F.col("after.event_ts").alias("next_event_ts"),
            *(
                [(F.col("rows_before") + F.col("in_position")).cast("bigint").alias("event_position")]
                if position
                else []
            ),
        )
    )
    return whole.unionByName(stitched)


# What the order, and therefore every transition, depends on.
SEQUENCE_COLUMNS = ("case_id", "activity", *ORDER_KEYS)


def transitions(log: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """One row per event: ``case_id, source, target, transition_ms``; no target on a last event."""
    return follow(log.select(*SEQUENCE_COLUMNS), policy).select(
        "case_id",
        F.col("activity").alias("source"),
        F.col("next_activity").alias("target"),
        F.col("event_ts"),
        F.col("next_event_ts"),
        millis_between(F.col("event_ts"), F.col("next_event_ts")).alias("transition_ms"),
    )
