"""Expressions on texts that several operators share; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions may use often: a generator keeps them from being computed again."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(made)).alias("_made")).select(
        *kept, *[F.col(f"_made.{n}").alias(n) for n in columns]
    )


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def windows(items: Column, size: int) -> Column:
    """A hash of each run of ``size`` neighbours; none in shorter arrays."""
    starts = F.sequence(F.lit(0), F.size(items) - size)
    return F.when(
        F.size(items) >= size, F.transform(starts, lambda i: F.xxhash64(*[F.get(items, i + k) for k in range(size)]))
    ).otherwise(F.array().cast("array<bigint>"))
