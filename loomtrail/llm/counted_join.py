"""Joins to a table of counted keys, of which one may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a key may have in a shuffle join.
HOT_ROWS = 100_000


def counted_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str, how: str = "inner", hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and the number ``n`` of ``rows`` with it.

    Keys of ``hot`` rows or more are joined by broadcast: there is at most one to ``hot`` rows. The others are
    shuffled. ``rows`` is read twice, so it should be a written table.
    """
    frequent = table.where(F.col(n) >= hot)
    found = rows.join(F.broadcast(frequent), keys)
    others = rows.join(F.broadcast(frequent.select(*keys)), keys, "left_anti").join(table.where(F.col(n) < hot), keys, how)
    return found.unionByName(others).drop(n)
