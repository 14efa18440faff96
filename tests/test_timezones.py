"""Time literals must not depend on the time zone of the Python process."""

import time
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from loomtrail.functions.timing import moment


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Seoul"])
def test_moment(spark, monkeypatch, zone):
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        row = spark.range(1).select(
            F.date_format(moment(datetime(2024, 1, 5, 1, 2, 3, 4)), "yyyy-MM-dd HH:mm:ss.SSSSSS"),
            F.date_format(moment(datetime(2024, 1, 5, tzinfo=UTC)), "yyyy-MM-dd HH"),
        ).first()
        assert tuple(row) == ("2024-01-05 01:02:03.000004", "2024-01-05 00")
    finally:
        monkeypatch.undo()
        time.tzset()
