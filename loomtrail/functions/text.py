"""Small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


# Whole, and decimal or exponent form. Testing the shape first spares casts that fail slowly.
WHOLE_SHAPE = r"^\s*[+-]?\d+\s*$"
NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def decimal_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))


def plain_integer(text: Column) -> Column:
    return F.when(text.rlike(WHOLE_SHAPE), text.try_cast("bigint"))


def whole_number(text: Column) -> Column:
    """Tolerant bigint: whole text exactly, otherwise a decimal or exponent form rounded."""
    return F.coalesce(plain_integer(text), F.round(decimal_number(text)).try_cast("bigint"))
