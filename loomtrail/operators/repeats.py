"""Maximal repeats: paths of any length that occur more than once in a case and cannot be made longer.

A repeat is maximal if its occurrences are not all preceded by one activity, nor all followed by one; beginning and
end of a case differ from every activity. All other repeated paths are parts of these with the same occurrences.

Positions get ranks by prefix doubling: after k rounds a rank orders positions by their next 2^k activities, and only
positions that still share theirs go on. In the final order neighbours have the longest common beginnings; their lengths are
found by the stored ranks, from long steps to short. A repeat is a run of neighbours whose common beginnings are no
shorter than its own; its bounds are the nearest shorter ones, looked up in a tree of minima over blocks of ``FAN``.
Ranks are running totals over range partitions and all lookups are joins by key, so a case may have any share of the rows
and a repeat any length. Numbers are packed so well in the staged files that these say little of what a table takes in memory;
tables that grow with the log are therefore merged, unless their counted rows are few. Rounds: the logarithm of the longest repeat.

Events without a case are left out; a missing activity is a step of its own.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrail.operators.running import ranked_running_total
from loomtrail.operators.sequence import SEQUENCE_COLUMNS, follow
from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, broadcast_checked, stage

#: Numbers per block of the tree of minima, as a power of two.
FAN_BITS = 6
FAN = 1 << FAN_BITS
REPEAT_COLUMNS = "case_id string, position long, length long, occurrences long"


#: A side with more counted bytes than this is merged.
KEYED_BYTES = 8 << 20


def _merged(df: DataFrame) -> DataFrame:
    return df.hint("merge")


def _counted(df: DataFrame, policy: ScalePolicy) -> DataFrame:
    """A staged table of plain columns as a side of a join: broadcast if its rows are few, so that a frequent key stays spread out."""
    few = replace(policy, broadcast_bytes=min(policy.broadcast_bytes, KEYED_BYTES))
    hinted = broadcast_checked(df, few, rows=df.count())
    return hinted if hinted is not df else _merged(df)


def _step_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("activity")), F.lit("")).alias("step_key")


def _first_ranks(log: DataFrame, policy: ScalePolicy) -> DataFrame:
    placed = stage(
        follow(log.where("case_id is not null").select(*SEQUENCE_COLUMNS), policy, position=True).select(
            "case_id", F.col("event_position").alias("pos"), _step_key()
        ),
        "repeat-positions",
    )
    groups = placed.groupBy("case_id", "step_key").agg(F.count("*").alias("n"))
    ranked = ranked_running_total(groups, [F.col("case_id").asc(), F.col("step_key").asc()], "n", policy)
    ranked = stage(ranked.select("case_id", "step_key", "n", (F.col("running_total") - F.col("n")).alias("rank")), "repeat-ranks")
    joined = placed.join(_counted(ranked, policy), ["case_id", "step_key"])
    return stage(joined.select("case_id", "pos", "rank", F.array("rank").alias("ranks"), "n"), "repeat-level")


def suffix_ranks(log: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> tuple[DataFrame, int]:
    """Per event ``case_id, pos, rank`` (0, 1, ... over the log, in the order of all that follows in the case) and
    ``ranks``, by the next 1, 2, 4, ... activities until the position is alone; and the number of rounds."""
    columns = ["case_id", "pos", "rank", "ranks"]
    level = _first_ranks(log, policy)
    settled, active, rounds = [level.where("n = 1").select(*columns)], level.where("n > 1").select(*columns), 1
    while not active.isEmpty():
        every = active
        for part in settled:
            every = every.unionByName(part)
        ahead = every.select("case_id", (F.col("pos") - F.lit(1 << (rounds - 1))).alias("pos"), F.col("rank").alias("second"))
        keyed = stage(
            active.join(_merged(ahead), ["case_id", "pos"], "left").withColumn("second", F.coalesce("second", F.lit(-1))), "repeat-keyed"
        )
        groups = keyed.groupBy(F.col("rank").alias("name"), "second").agg(F.count("*").alias("n"))
        ranked = ranked_running_total(groups, [F.col("name").asc(), F.col("second").asc()], "n", policy)
        before = (F.col("running_total") - F.col("n")).alias("before")
        ranked = stage(ranked.select(F.col("name").alias("rank"), "second", "n", before), "repeat-ranks")
        # A rank keeps its place: what is told apart now moves up by the rows of its group that come before.
        base = ranked.groupBy("rank").agg(F.min("before").alias("base"))
        moved = stage(
            ranked.join(_merged(base), "rank").select(
                "rank", "second", "n", (F.col("rank") + F.col("before") - F.col("base")).alias("moved")
            ),
            "repeat-moved",
        )
        level = stage(
            keyed.join(_counted(moved, policy), ["rank", "second"]).select(
                "case_id", "pos", F.col("moved").alias("rank"), F.concat("ranks", F.array("moved")).alias("ranks"), "n"
            ),
            "repeat-level",
        )
        settled.append(level.where("n = 1").select(*columns))
        active, rounds = level.where("n > 1").select(*columns), rounds + 1
    every = settled[0]
    for part in settled[1:]:
        every = every.unionByName(part)
    return stage(every, "suffix-ranks"), rounds


def neighbour_prefixes(ranked: DataFrame, rounds: int) -> DataFrame:
    """Per rank: ``rank, case_id, pos, lcp`` (activities shared with the position before it in the order) and
    ``differs`` (1 if the two are preceded by different activities)."""
    before = ranked.select("case_id", (F.col("pos") + 1).alias("pos"), F.col("ranks")[0].alias("left"))
    known = stage(
        ranked.join(_merged(before), ["case_id", "pos"], "left").withColumn("left", F.coalesce("left", F.lit(-1))), "repeat-left"
    )
    previous = known.select(
        (F.col("rank") + 1).alias("rank"), F.col("case_id").alias("p_case"), F.col("pos").alias("p_pos"),
        F.col("ranks").alias("p_ranks"), F.col("left").alias("p_left"),
    )
    last = F.least(F.size("ranks"), F.size("p_ranks")) - 1
    shared = F.size(F.filter(F.sequence(F.lit(0), last), lambda k: F.get("ranks", k) == F.get("p_ranks", k)))
    same_case = F.col("case_id") == F.col("p_case")
    pairs = (
        known.join(_merged(previous), "rank", "left")
        .withColumn("shared", F.when(same_case, shared).otherwise(0))
        .select(
            "rank", "case_id", "pos", "p_pos", "shared",
            F.when(F.col("shared") > 0, F.expr("shiftleft(1L, shared - 1)")).otherwise(0).alias("lcp"),
            F.when(same_case & (F.col("left") == F.col("p_left")), 0).otherwise(1).alias("differs"),
        )
    )
    pairs = stage(pairs, "repeat-pairs")
    for k in range(rounds - 3, -1, -1):
        # Who shares 2^(shared - 1) activities and not twice as many has at most the steps below that left to take.
        open_ = F.col("shared") >= k + 2
        names = ranked.select("case_id", F.col("pos").alias("at"), F.get("ranks", F.lit(k)).alias("name")).where("name is not null")
        own = names.withColumnsRenamed({"at": "own_at", "name": "own"})
        other = names.withColumnsRenamed({"at": "other_at", "name": "other"})
        taken = (
            pairs.where(open_)
            .withColumn("own_at", F.col("pos") + F.col("lcp"))
            .withColumn("other_at", F.col("p_pos") + F.col("lcp"))
            .join(_merged(own), ["case_id", "own_at"], "left")
            .join(_merged(other), ["case_id", "other_at"], "left")
            .withColumn("lcp", F.col("lcp") + F.when(F.col("own") == F.col("other"), F.lit(1 << k)).otherwise(0))
        )
        pairs = stage(pairs.where(~open_).unionByName(taken.select(*pairs.columns)), "repeat-pairs")
    return pairs.select("rank", "case_id", "pos", "lcp", "differs")


def _minima(values: DataFrame) -> list[DataFrame]:
    """Trees of minima of ``at, value``: per level ``block, values`` (the values of a block in order), as a side of a join.

    The few blocks of upper levels are asked for by all that is left, so they are broadcast.
    """
    levels = []
    while True:
        blocks = values.groupBy(F.shiftright("at", FAN_BITS).alias("block")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda e: e["value"]).alias("values")
        )
        level = stage(blocks, "repeat-minima")
        last = level.agg(F.max("block")).first()[0]
        levels.append(F.broadcast(level) if last < FAN * FAN else _merged(level))
        if last == 0:
            return levels
        values = level.select(F.col("block").alias("at"), F.array_min("values").alias("value"))


def nearest_smaller(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each row ``at, value, right`` of ``wanted`` the nearest place with a smaller value: ``found``.

    To the right of ``at`` or to its left. ``values`` numbers its places from 0 without gaps. One has to exist.
    """
    levels = _minima(values)

    def look(rows: DataFrame, level: int, block: Column, lowest: Column, highest: Column) -> DataFrame:
        joined = rows.withColumn("block", block).join(levels[level], "block")
        end = F.size("values") - 1
        span = F.when(
            F.greatest(lowest, F.lit(0)) <= F.least(highest, end),
            F.sequence(F.greatest(lowest, F.lit(0)), F.least(highest, end)),
        ).otherwise(F.array().cast("array<int>"))
        hits = F.filter(span, lambda i: F.get("values", i) < F.col("value"))
        hit = F.when(F.col("right"), F.array_min(hits)).otherwise(F.array_max(hits))
        return joined.withColumn("hit", F.shiftleft("block", FAN_BITS) + hit).drop("block", "values")

    rows = wanted.withColumn("place", F.col("at"))
    met = []
    for level in range(len(levels)):  # up, until a block holds a smaller value
        inside = F.col("place").bitwiseAND(F.lit(FAN - 1)).cast("int")
        lowest = F.when(F.col("right"), inside + 1).otherwise(0)
        highest = F.when(F.col("right"), FAN).otherwise(inside - 1)
        seen = stage(look(rows, level, F.shiftright("place", FAN_BITS), lowest, highest), "repeat-search")
        met.append(seen.where("hit is not null").select("at", "value", "right", F.col("hit").alias("place")))
        rows = seen.where("hit is null").select("at", "value", "right", F.shiftright("place", FAN_BITS).alias("place"))
    down = met[-1]
    for level in range(len(levels) - 2, -1, -1):  # and down again to the place itself
        below = look(down, level, F.col("place"), F.lit(0), F.lit(FAN))
        down = met[level].unionByName(below.select("at", "value", "right", F.col("hit").alias("place")))
    return down.withColumnRenamed("place", "found")


def maximal_repeats(log: DataFrame, least_length: int = 2, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """``case_id, position, length, occurrences``: one row per maximal repeat of a case, with the place of one occurrence."""
    if least_length < 1:
        raise ValueError("least_length must be positive")
    ranked, rounds = suffix_ranks(log, policy)
    order = neighbour_prefixes(ranked, rounds)
    n = order.count()
    if not n:
        return log.sparkSession.createDataFrame([], REPEAT_COLUMNS)
    order = ranked_running_total(order, [F.col("rank").asc()], "differs", policy).withColumnRenamed("running_total", "changes")
    # ``rank`` was renumbered from 1 by the running total.
    order = stage(order.select((F.col("rank") - 1).alias("at"), "case_id", "pos", "lcp", "changes"), "repeat-order")
    end = log.sparkSession.range(n, n + 1, 1, 1).select(F.col("id").alias("at"), F.lit(-1).cast("long").alias("value"))
    values = order.select("at", F.col("lcp").alias("value")).unionByName(end)
    starts = order.where(F.col("lcp") >= least_length)
    wanted = starts.select("at", F.col("lcp").alias("value"), F.explode(F.array(F.lit(False), F.lit(True))).alias("right"))
    sides = nearest_smaller(values, wanted).groupBy("at").agg(
        F.max(F.when(~F.col("right"), F.col("found"))).alias("low"), F.max(F.when(F.col("right"), F.col("found"))).alias("high")
    )
    # Neighbours with one bound on either side and equal length are one repeat.
    found = starts.join(_merged(sides), "at").groupBy("low", "high").agg(
        F.min_by(F.struct("case_id", "pos", "lcp"), "at").alias("one"), (F.col("high") - F.col("low")).alias("occurrences")
    )
    at_low = order.select(F.col("at").alias("low"), F.col("changes").alias("changes_low"))
    at_high = order.select((F.col("at") + 1).alias("high"), F.col("changes").alias("changes_high"))
    diverse = found.join(_merged(at_low), "low").join(_merged(at_high), "high").where(F.col("changes_high") > F.col("changes_low"))
    return diverse.select(
        F.col("one.case_id").alias("case_id"), F.col("one.pos").alias("position"), F.col("one.lcp").alias("length"), "occurrences"
    )


def repeat_steps(log: DataFrame, repeats: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """The activities of ``repeats``, one row per step: their columns, ``step`` (from 0) and ``step_activity``.

    Rows grow with the lengths asked for; only cases with a repeat are ordered.
    """
    cases = log.join(_counted(stage(repeats.select("case_id").distinct(), "repeat-cases"), policy), "case_id", "left_semi")
    placed = follow(cases.select(*SEQUENCE_COLUMNS), policy, position=True).select(
        "case_id", F.col("event_position").alias("at"), F.col("activity").alias("step_activity")
    )
    steps = repeats.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("step"))
    return steps.withColumn("at", F.col("position") + F.col("step")).join(_merged(placed), ["case_id", "at"]).drop("at")
