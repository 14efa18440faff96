"""Registration of queries next to the SQL statement each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrail.functions.timing import use_utc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_TEXT_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{folder}/{name}.parquet")


def present(df: DataFrame) -> DataFrame:
    """Comparable output: timestamps and dates as text, doubles at six decimals (milliseconds at three)."""
    shown = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, _TEXT_TS)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 3 if f.name.endswith("_ms") else 6)
        shown.append(c.alias(f.name))
    return df.select(*shown)


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = lambda spark, folder: present(fn(spark, folder))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def ts_text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
