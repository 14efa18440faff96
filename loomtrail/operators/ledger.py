"""Keys of all batches loaded so far, to find duplicates across batches without reading them again.

A ledger holds one row per key and batch: two 64-bit hashes of the key and its number of rows, in folders by the first bits of the
hash ("parts"). Next to them lies a Bloom filter per part and batch, as words of bits; words of several batches are united by OR.
A new batch asks the filters of its own parts first, and reads keys from those parts only in which a filter may know one of its keys.
What the filters let pass is compared by its hashes, so a full filter costs reads, never rows.

``add_batch`` writes below a folder of its own and commits it under the next number (see ``sources.commits``): a batch that has been
committed is not added again, one that failed is repeated, and of two writers at once the second is told.
Missing parts of a key equal each other. Keys are told apart by 128 bits of hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrail.functions.text import blank_to_null
from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, broadcast_checked, stage
from loomtrail.sources import commits

#: Parts of a new ledger and bits of each part's filter. At ten bits a key they serve 400 million keys well.
PARTS, FILTER_BITS = 1024, 1 << 22
PROBES = 5
COMMITS = "number long, batch_id string, folder string, parts int, filter_bits long, row_count long, key_count long, known_keys long, known_rows long"
_KEY = ["part", "key_1", "key_2"]


def event_key() -> list[Column]:
    """What tells events of a validated log apart: the event id, without one case, activity and time."""
    event = blank_to_null(F.col("event_id"))
    rest = [F.when(event.isNull(), F.col(c)) for c in ("case_id", "activity", "event_ts")]
    return [event, *rest]


def _hashed(keys: Sequence[Column], parts: int) -> list[Column]:
    flagged = [f for k in keys for f in (k.isNull(), k)]
    one, two = (F.xxhash64(F.lit(seed), *flagged) for seed in (0x1ED6E4, 0xBA7C4))
    return [F.pmod(one, F.lit(parts)).cast("int").alias("part"), one.alias("key_1"), two.alias("key_2")]


def _counted(rows: DataFrame, keys: Sequence[Column], parts: int) -> DataFrame:
    """Rows per key, counted before the shuffle."""
    return rows.select(*_hashed(keys, parts)).groupBy(*_KEY).agg(F.count("*").alias("row_count"))


def _bits(keys: DataFrame, filter_bits: int) -> DataFrame:
    """The places of each key in its part's filter: ``word`` and ``bit``."""
    probe = F.explode(F.array(*[F.lit(k) for k in range(PROBES)])).alias("probe")
    place = F.pmod(F.xxhash64("probe", "key_2", "key_1"), F.lit(filter_bits))
    return keys.select(*_KEY, probe).withColumn("place", place).select(
        *_KEY, F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")
    )


def batches(spark: SparkSession, root: str) -> DataFrame:
    """The committed batches: number, id, rows, different keys, and how many of both were known before."""
    return commits.committed(spark, f"{root}/commits", COMMITS)


def _read(spark: SparkSession, root: str, kind: str, columns: str, parts: Sequence[int], before: int | None) -> DataFrame:
    rows = batches(spark, root)
    if before is not None:
        rows = rows.where(F.col("number") < before)
    folders = [f"{root}/{kind}/batch={r['folder']}" for r in rows.select("folder").collect()]  # one per batch
    schema = f"{columns}, part int, batch string"
    if not folders:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(schema).option("basePath", f"{root}/{kind}").parquet(*folders)
    return read.where(F.col("part").isin(list(parts)))


def candidates(spark: SparkSession, root: str, keys: DataFrame, filter_bits: int, before: int | None = None) -> DataFrame:
    """The ``keys`` that a filter may know."""
    touched = [r["part"] for r in keys.select("part").distinct().collect()]  # at most the parts of the layout
    words = _read(spark, root, "filters", "word long, bits long", touched, before)
    united = words.groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
    asked = _bits(keys, filter_bits).join(united, ["part", "word"])
    met = asked.where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return met.groupBy(*_KEY).agg(F.count("*").alias("met")).where(F.col("met") == PROBES).drop("met")


def known_keys(spark: SparkSession, root: str, keys: DataFrame, filter_bits: int, before: int | None = None) -> DataFrame:
    """Of ``keys`` those in the ledger: ``part, key_1, key_2, earlier_rows, first_batch`` (its folder)."""
    asked = stage(candidates(spark, root, keys, filter_bits, before), "ledger-candidates")
    parts = [r["part"] for r in asked.select("part").distinct().collect()]
    stored = _read(spark, root, "keys", "key_1 long, key_2 long, row_count long", parts, before)
    # The stored side is met by each batch once; equal keys are added up before they meet again.
    return stored.join(asked, _KEY, "left_semi").groupBy(*_KEY).agg(
        F.sum("row_count").alias("earlier_rows"), F.min("batch").alias("first_batch")
    )


def _layout(spark: SparkSession, root: str, parts: int, filter_bits: int) -> tuple[int, int, int]:
    """Number of the last batch, and the layout: of the ledger if it has one."""
    last, p, b = batches(spark, root).agg(F.coalesce(F.max("number"), F.lit(0)), F.max("parts"), F.max("filter_bits")).first()
    return last, p or parts, b or filter_bits


def flag_batch(
    spark: SparkSession, root: str, rows: DataFrame, keys: Sequence[Column], batch_id: str | None = None,
    policy: ScalePolicy = DEFAULT_POLICY,
) -> DataFrame:
    """``rows`` with ``rows_in_batch``, ``earlier_rows`` (equal keys in batches before), ``first_batch_id`` and ``duplicate``.

    Before which batch: the one named, if it is in the ledger already, else all. Every member of a group of equal
    keys is a duplicate. Only repeated or known keys are joined to the rows, so one key may have any share of new rows.
    """
    _, parts, filter_bits = _layout(spark, root, PARTS, FILTER_BITS)
    own = batches(spark, root).where(F.col("batch_id") == F.lit(batch_id)).first()
    counted = stage(_counted(rows, keys, parts), "ledger-batch")
    known = known_keys(spark, root, counted.select(*_KEY), filter_bits, own["number"] if own else None)
    names = batches(spark, root).select(F.col("folder").alias("first_batch"), F.col("batch_id").alias("first_batch_id"))
    told = known.join(broadcast_checked(names, policy), "first_batch", "left").drop("first_batch")
    marked = counted.join(told, _KEY, "left").where((F.col("row_count") > 1) | F.col("earlier_rows").isNotNull())
    marked = stage(marked.withColumnsRenamed({k: f"_{k}" for k in _KEY} | {"row_count": "rows_in_batch"}), "ledger-marked")
    hashed = rows.select("*", *[h.alias(f"_{k}") for h, k in zip(_hashed(keys, parts), _KEY)])
    joined = hashed.join(broadcast_checked(marked, policy), [f"_{k}" for k in _KEY], "left")
    earlier = F.coalesce("earlier_rows", F.lit(0))
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.coalesce("rows_in_batch", F.lit(1)).alias("rows_in_batch"),
        earlier.alias("earlier_rows"),
        "first_batch_id",
        F.col("rows_in_batch").isNotNull().alias("duplicate"),
    )


def add_batch(
    spark: SparkSession, root: str, batch_id: str, rows: DataFrame, keys: Sequence[Column], parts: int = PARTS,
    filter_bits: int = FILTER_BITS,
) -> bool:
    """Add the keys of a batch; False if it has been added before. ``parts`` and ``filter_bits`` count for a new ledger only."""
    if parts < 1 or filter_bits < 64 or filter_bits % 64:
        raise ValueError("a ledger needs a part, and filters of whole words")
    if not batches(spark, root).where(F.col("batch_id") == batch_id).isEmpty():
        return False
    last, parts, filter_bits = _layout(spark, root, parts, filter_bits)
    counted = stage(_counted(rows, keys, parts), "ledger-batch")
    known = known_keys(spark, root, counted.select(*_KEY), filter_bits)
    sums = counted.join(known.select(*_KEY, F.lit(True).alias("known")), _KEY, "left").agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), F.count("*").alias("key_count"),
        F.count_if("known").alias("known_keys"), F.coalesce(F.sum(F.when(F.col("known"), F.col("row_count"))), F.lit(0)).alias("known_rows"),
    ).first()
    folder = f"{last + 1:08d}-{uuid.uuid4().hex}"
    words = _bits(counted, filter_bits).groupBy("part", "word").agg(F.bit_or("bit").alias("bits"))
    for kind, table in (("keys", counted.select("key_1", "key_2", "row_count", "part")), ("filters", words.select("word", "bits", "part"))):
        dealt = table.hint("rebalance", F.col("part"))
        dealt.write.option("compression", "zstd").partitionBy("part").parquet(f"{root}/{kind}/batch={folder}")
    row = {"batch_id": batch_id, "folder": folder, "parts": parts, "filter_bits": filter_bits, **sums.asDict()}
    commits.commit(spark, f"{root}/commits", last + 1, row)
    return True
