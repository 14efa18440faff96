"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Large items, above a third of the capacity, pair at most twice per bin by greedy matching: the
largest open item takes the largest that still fits beside it. Smaller items then go, largest
first, into the tightest gap that holds them.

Only lengths decide where a piece goes, so the plan is made from the count of pieces per length: at
most ``capacity`` rows, whatever the size of the corpus. Runs of equal lengths are placed at once,
which gives the same bins as placing them one by one. A piece finds its place by its rank among
the pieces of its length: its rank within the task that encoded it plus the pieces that earlier
tasks have of that length.

Results on edge cases: a null or empty text is one piece that holds the end id only; equal rows are
packed each for itself; ties are broken by the input order; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtrail.llm import tokens
from loomtrail.scale import stage

CAPACITY = 1024

_PIECES = (
    "doc_id long, piece int, start long, length long, ids binary, encoded_by int, rank_there long"
)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Documents as pieces of token ids, cut only where a document is longer than the capacity.

    The first piece of a cut document is the short one. ``ids`` holds little-endian unsigned 32-bit
    integers. Columns ``encoded_by`` and ``rank_there`` number the pieces of one length within a task.
    """
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        schema = pa.schema(
            [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
             ("ids", pa.binary()), ("encoded_by", pa.int32()), ("rank_there", pa.int64())]
        )
        for part, found in tokens.encoded(batches, path, 1):
            rows: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(part.column(0).to_pylist(), found):
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k in range(len(cuts) - 1):
                    a, b = cuts[k], cuts[k + 1]
                    rank = seen.get(b - a, 0)
                    seen[b - a] = rank + 1
                    for column, value in zip(rows, (doc, k, a, b - a, ids[4 * a : 4 * b], rank)):
                        column.append(value)
            rows.insert(5, [task] * len(rows[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


@dataclass
class _Bins:
    """Equal bins: how many, what is left in each and what each holds as (length, copies)."""

    count: int
    gap: int
    items: list[tuple[int, int]] = field(default_factory=list)

    def with_items(self, count: int, length: int, copies: int) -> _Bins:
        return _Bins(count, self.gap - length * copies, [*self.items, (length, copies)])


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[_Bins]:
    """Bins for so many items of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths lie between 1 and the capacity")
    bins: list[_Bins] = []
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1
        if at >= 0 and large[at] == n and left[n] < 2:
            at -= 1
        if at < 0:
            bins.append(_Bins(left.pop(large.pop()), capacity - n, [(n, 1)]))
            continue
        m = large[at]
        pairs = left[n] // 2 if m == n else min(left[n], left[m])
        bins.append(_Bins(pairs, capacity - n - m, [(n, 2)] if m == n else [(n, 1), (m, 1)]))
        for k in (n, m):
            left[k] -= pairs
        large = [k for k in large if left[k]]
    by_gap: dict[int, list[_Bins]] = {}
    for b in bins:
        by_gap.setdefault(b.gap, []).append(b)
    gaps = sorted(by_gap)

    def put(b: _Bins) -> None:
        if b.gap not in by_gap:
            by_gap[b.gap] = []
            insort(gaps, b.gap)
        by_gap[b.gap].append(b)

    for n in sorted((k for k in left if left[k] and 3 * k <= capacity), reverse=True):
        c = left[n]
        for gap in gaps[bisect_left(gaps, n) :]:
            while c and by_gap[gap]:
                b = by_gap[gap].pop()
                copies = gap // n
                full = min(b.count, c // copies)
                rest = c - full * copies if full < b.count else 0
                if full:
                    put(b.with_items(full, n, copies))
                if rest:
                    put(b.with_items(1, n, rest))
                c -= full * copies + rest
                if over := b.count - full - (rest > 0):
                    by_gap[gap].append(_Bins(over, gap, b.items))
            if not c:
                break
        copies = capacity // n
        if c >= copies:
            put(_Bins(c // copies, capacity).with_items(c // copies, n, copies))
        if c % copies:
            put(_Bins(1, capacity).with_items(1, n, c % copies))
    return [b for gap in gaps for b in by_gap[gap]]


def _slots(spark: SparkSession, bins: list[_Bins]) -> DataFrame:
    """Ranks of a length and where they go; a few rows per length."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for b in bins:
        offset = 0
        for n, copies in b.items:
            at = taken.get(n, 0)
            taken[n] = at + b.count * copies
            rows.append((n, at, taken[n], first, copies, offset))
            offset += n * copies
        first += b.count
    names = ("slot_length", "rank_from", "rank_to", "first_sequence", "copies", "slot_offset")
    columns = zip(*rows) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)}))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of :func:`token_pieces`; other columns pass through.

    ``pieces`` is read twice and must be a stored table.
    """
    spark = pieces.sparkSession
    per_task = pieces.groupBy("encoded_by", "length").agg(F.count(F.lit(1)).alias("n_here"))
    before = W.partitionBy("length").orderBy("encoded_by").rowsBetween(W.unboundedPreceding, -1)
    counted = per_task.withColumn("n_before", F.coalesce(F.sum("n_here").over(before), F.lit(0)))
    # At most one row per length.
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n_here").alias("n")).collect()}
    slots = _slots(spark, plan_bins(counts, capacity))
    ranked = pieces.join(counted.select("encoded_by", "length", "n_before"), ["encoded_by", "length"]).withColumn(
        "rank", F.col("rank_there") + F.col("n_before")
    )
    # Slots: bounded by the capacity (runs of equal lengths), whatever the number of pieces.
    placed = ranked.join(
        F.broadcast(slots),
        (F.col("length") == F.col("slot_length"))
        & (F.col("rank") >= F.col("rank_from"))
        & (F.col("rank") < F.col("rank_to")),
    )
    nth = F.col("rank") - F.col("rank_from")
    kept = [c for c in pieces.columns if c not in ("encoded_by", "rank_there")]
    return placed.select(
        *kept,
        (F.col("first_sequence") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("slot_offset") + F.col("length") * (nth % F.col("copies"))).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every piece of every document with its ids, sequence and offset."""
    return place(stage(token_pieces(docs, capacity, path), "packing-pieces"), capacity)


def fewest_possible(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing needs fewer sequences."""
    return math.ceil(sum(n * c for n, c in counts.items()) / capacity)
