"""Millisecond arithmetic on zone-free timestamps, whatever the time zone of the session."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def use_utc(spark: SparkSession) -> SparkSession:
    """The whole library reads zone-free timestamps as UTC fields."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def moment(value: datetime) -> Column:
    """A zone-free literal holding UTC fields; independent of the time zone of the Python process."""
    if value.tzinfo is not None:
        value = value.astimezone(UTC).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of the fields as they are written."""
    since = ts.cast("timestamp_ntz") - moment(datetime(1970, 1, 1))
    return F.floor(since.cast("interval second").cast("decimal(20,6)") * 1000).cast("bigint")


def millis_between(start: Column, end: Column) -> Column:
    """Count of millisecond boundaries crossed between two timestamps."""
    return epoch_millis(end) - epoch_millis(start)


def ratio(part: Column, whole: Column) -> Column:
    """Share as double, 0.0 when there is nothing to divide by."""
    return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0))
