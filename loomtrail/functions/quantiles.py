"""Exact interpolated quantiles of whole numbers (milliseconds, counts), per group.

The built-in ``percentile`` keeps every distinct value of a group in one buffer that cannot
spill. It is used where a count has shown that no group has more than ``BUFFERED_ROWS`` rows.
Otherwise values are counted in coarse bins first, which combines before the shuffle; the few bins
that hold the wanted ranks are divided again until each is small, and only their rows are sorted. One
group, or one value, may hold most of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, broadcast_checked, stage

BINS_PER_OCTAVE = 128
BUFFERED_ROWS = 500_000
#: Parts a bin is divided into when it holds too many values.
PARTS = 4096


def value_bin(value: Column) -> Column:
    """Order-preserving bin of a bigint: 128 bins per power of two (the logarithm is monotone)."""
    place = F.floor(F.log2(F.abs(value) + F.lit(1.0)) * BINS_PER_OCTAVE).cast("int")
    return F.when(value < 0, -place).otherwise(place)


def split_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, float],
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Exact quantiles per key. ``rows`` is read twice, so it should be a table or staged."""
    keys = list(keys)
    binned = (
        rows.filter(F.col(value).isNotNull())
        .select(*keys, F.col(value).alias("_value"))
        .withColumn("_bin", value_bin(F.col("_value")))
    )
    before = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = (
        binned.groupBy(*keys, "_bin")
        .agg(F.count("*").alias("_rows"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_rows").over(W.partitionBy(*keys)))
    )
    position = {q: F.lit(p) * (F.col("_total") - 1) for q, p in wanted.items()}

    def holds(rank: Column, start: str, length: str) -> Column:
        return (rank >= F.col(start)) & (rank < F.col(start) + F.col(length))

    def ranks(q: str) -> tuple[Column, Column]:
        return F.floor(position[q]), F.ceil(position[q])

    needed = F.lit(False)
    for q in wanted:
        for rank in ranks(q):
            needed = needed | holds(rank, "_start", "_rows")
    # At most two bins per key and quantile; staged so that its size is known before it is joined.
    targets = stage(
        bins.filter(needed).select(*keys, "_bin", "_start", "_total", "_rows", "_low", "_high"), "quantile-bins"
    )
    bound = min(policy.max_group_rows, BUFFERED_ROWS)
    wide = (F.col("_rows") > bound) & (F.col("_high") > F.col("_low"))
    while not targets.filter(wide).isEmpty():
        # Divide every bin again, by value; a part of one value needs no further division.
        width = F.ceil((F.col("_high") - F.col("_low") + 1) / PARTS).cast("bigint")
        part = F.floor((F.col("_value") - F.col("_low")) / width).cast("int")
        old = targets.select(*keys, "_bin", F.col("_start").alias("_from"), "_total", "_low", "_high")
        binned = (
            binned.join(broadcast_checked(old, policy), [*keys, "_bin"])
            .select(*keys, "_value", "_total", "_from", F.struct("_bin", part.alias("part")).alias("_bin"))
            .withColumn("_bin", F.sha2(F.to_json("_bin"), 256))
        )
        first = W.partitionBy(*keys, "_from").orderBy("_low").rowsBetween(W.unboundedPreceding, -1)
        parts = (
            binned.groupBy(*keys, "_bin", "_from", "_total")
            .agg(F.count("*").alias("_rows"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))
            .withColumn("_start", F.col("_from") + F.coalesce(F.sum("_rows").over(first), F.lit(0)))
        )
        targets = stage(parts.filter(needed).select(*targets.columns), "quantile-bins")
        binned = binned.drop("_from", "_total")

    inside = W.partitionBy(*keys, "_bin").orderBy("_value").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        binned.join(broadcast_checked(targets.drop("_rows", "_low", "_high"), policy), [*keys, "_bin"])
        .groupBy(*keys, "_bin", "_start", "_total", "_value")
        .agg(F.count("*").alias("_n"))
        .withColumn("_first", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    )
    picks = []
    for q in wanted:
        lo, hi = ranks(q)
        picks.append(F.max(F.when(holds(lo, "_first", "_n"), F.col("_value"))).alias(f"_lo_{q}"))
        picks.append(F.max(F.when(holds(hi, "_first", "_n"), F.col("_value"))).alias(f"_hi_{q}"))
    found = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    return found.select(
        *keys,
        *[
            (
                F.col(f"_lo_{q}")
                + (position[q] - F.floor(position[q])) * (F.col(f"_hi_{q}") - F.col(f"_lo_{q}"))
            ).alias(q)
            for q in wanted
        ],
    )


def percentile_columns(value: str | Column, wanted: dict[str, float]) -> list[Column]:
    """One shared percentile buffer, one output column per quantile; for groups of bounded size."""
    many = F.percentile(value, list(wanted.values()))
    return [many[i].alias(q) for i, q in enumerate(wanted)]


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, float],
    policy: ScalePolicy = DEFAULT_POLICY,
    staged: bool = False,
    largest: int | None = None,
) -> DataFrame:
    """Exact quantiles per group, buffered or by bins as the counted rows of the largest group ask for.

    Pass ``staged`` when ``df`` is a table already, so that it is not written again, and ``largest`` when the rows of the
    largest group are known.
    """
    rows = df if staged else stage(df.select(*keys, value), "quantile-values")
    if largest is None:
        largest = rows.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= min(policy.max_group_rows, BUFFERED_ROWS):
        return rows.groupBy(*keys).agg(*percentile_columns(value, wanted))
    return split_quantiles(rows, keys, value, wanted, policy)


def one_row(spread: DataFrame, wanted: dict[str, float]) -> Column:
    """Ungrouped quantiles as a single struct value."""
    return spread.select(F.struct(*wanted)).scalar()
