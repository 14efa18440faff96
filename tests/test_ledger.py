"""The ledger of keys against plain sets, for batches in a row."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtrail.operators import ledger
from loomtrail.scale import staged_path
from loomtrail.sources.commits import CommitConflict


def keys():
    return [F.col("a"), F.col("b")]


def batch(spark, rows):
    return spark.createDataFrame(rows, "a string, b long, c string")


def drawn(rng, n):
    return [(rng.choice(["x", "y", None, ""]), rng.choice([None, *range(60)]), f"r{k}") for k in range(n)] + [("hot", 0, "h")] * n


@pytest.mark.parametrize("filter_bits", [64, 1 << 12])
def test_batches_against_counters(spark, filter_bits):
    # Filters of 64 bits are full at once: they cost reads, never rows.
    rng, root, seen = random.Random(filter_bits), staged_path(spark, "ledger"), {}
    for name in ("b1", "b2", "b3"):
        rows = drawn(rng, 60)
        own = Counter((a, b) for a, b, _ in rows)
        flagged = ledger.flag_batch(spark, root, batch(spark, rows), keys())
        assert flagged.columns == ["a", "b", "c", "rows_in_batch", "earlier_rows", "first_batch_id", "duplicate"]
        want = []
        for a, b, c in rows:
            earlier, first = seen.get((a, b), (0, None))
            want.append((a, b, c, own[a, b], earlier, first, own[a, b] > 1 or earlier > 0))
        assert Counter(tuple(r) for r in flagged.collect()) == Counter(want)
        assert ledger.add_batch(spark, root, name, batch(spark, rows), keys(), 8, filter_bits)
        assert not ledger.add_batch(spark, root, name, batch(spark, rows), keys())
        # A batch in the ledger is judged by those before it.
        again = ledger.flag_batch(spark, root, batch(spark, rows), keys(), batch_id=name)
        assert Counter(tuple(r) for r in again.collect()) == Counter(want)
        last = ledger.batches(spark, root).where(F.col("batch_id") == name).first()
        known = {k for k in own if k in seen}
        assert (last.row_count, last.key_count, last.known_keys) == (len(rows), len(own), len(known))
        assert last.known_rows == sum(own[k] for k in known)
        for k, n in own.items():
            seen[k] = (seen.get(k, (0, name))[0] + n, seen.get(k, (0, name))[1])


def test_only_parts_that_may_hold_a_key_are_read(spark):
    root = staged_path(spark, "ledger")
    ledger.add_batch(spark, root, "old", batch(spark, [("k", n, "") for n in range(2000)]), keys(), 64, 1 << 12)
    new = batch(spark, [("k", 5, ""), *[("new", n, "") for n in range(2000)]])
    counted = ledger._counted(new, keys(), 64).select("part", "key_1", "key_2")
    assert counted.select("part").distinct().count() == 64
    known = ledger.known_keys(spark, root, counted, 1 << 12)
    assert [r.earlier_rows for r in known.collect()] == [1]
    pruned = re.search(r"PartitionFilters: \[[^\n]*part#\d+[^\n]*", known._jdf.queryExecution().toString())
    assert pruned and len(ledger.candidates(spark, root, counted, 1 << 12).select("part").distinct().collect()) < 16


def test_empty_batches_and_conflicts(spark, monkeypatch):
    root, none = staged_path(spark, "ledger"), batch(spark, [])
    assert ledger.flag_batch(spark, root, none, keys()).count() == 0
    assert ledger.add_batch(spark, root, "empty", none, keys())
    assert ledger.flag_batch(spark, root, batch(spark, [("a", 1, "")]), keys()).first().duplicate is False
    rows = batch(spark, [("a", 1, "")])
    # Another writer takes the number between the look at the ledger and the commit.
    monkeypatch.setattr(ledger, "_layout", lambda *_: (0, 1024, 1 << 22))
    with pytest.raises(CommitConflict):
        ledger.add_batch(spark, root, "late", rows, keys())
    monkeypatch.undo()
    assert ledger.flag_batch(spark, root, rows, keys()).first().earlier_rows == 0
    assert ledger.add_batch(spark, root, "late", rows, keys())
    assert ledger.flag_batch(spark, root, rows, keys()).first().earlier_rows == 1
    with pytest.raises(ValueError):
        ledger.add_batch(spark, root, "x", rows, keys(), filter_bits=100)


def test_event_key(spark):
    rows = [("e1", "c", "A", "1"), ("e1", "d", "B", "2"), (" ", "c", "A", "1"), (None, "c", "A", "1"), (None, None, "A", "1")]
    log = spark.createDataFrame(rows, "event_id string, case_id string, activity string, event_ts string")
    flagged = ledger.flag_batch(spark, staged_path(spark, "ledger"), log, ledger.event_key())
    assert sorted(r.rows_in_batch for r in flagged.collect()) == [1, 2, 2, 2, 2]
