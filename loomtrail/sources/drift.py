"""Has a source changed since it was registered, and where?

``range_checksums`` needs no file in one value: lines are hashed where they are read, with their place in bytes, and the hashes
of a range of the file are added up (128 bits). A sum does not depend on how the file was split between tasks. The checksum of a
file is a hash of its ranges in order and of its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrail.scale import broadcast_checked, stage

RANGE_BYTES = 64 << 20


def file_listing(spark: SparkSession, path: str, checksum: bool = False) -> DataFrame:
    """Path, length and modification time of files. Content is read only for a checksum, which
    needs each file to fit one value (2 GB); see ``range_checksums`` for larger ones."""
    files = spark.read.format("binaryFile").load(path)
    shown = files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    if not checksum:
        return shown
    return files.select(
        "path",
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.sha2("content", 256).alias("checksum"),
    )


def source_drift(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """``UNCHANGED``, ``CHANGED``, ``MISSING`` or ``NEW`` per file."""
    compared = [c for c in manifest.columns if c != "path"]
    old = manifest.select("path", F.struct(*compared).alias("registered"))
    now = current.select("path", F.struct(*compared).alias("found"))
    return old.join(now, "path", "full_outer").select(
        "path",
        F.when(F.col("found").isNull(), "MISSING")
        .when(F.col("registered").isNull(), "NEW")
        .when(F.col("found").eqNullSafe(F.col("registered")), "UNCHANGED")
        .otherwise("CHANGED")
        .alias("drift"),
    )


def range_checksums(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, range_number, start_byte, digest`` per range of a file, in which a line counts where it begins."""
    line = F.col("value").cast("binary")
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), (F.octet_length(line) + 1).cast("long").alias("size"),
        F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"),
    )
    lines = stage(read, "line-hashes")
    blocks = lines.groupBy("path", "block").agg(F.sum("size").alias("block_size"))
    # One row per block of a file.
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("path", "block", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("begun"))
    inside = W.partitionBy("path", "block").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    placed = lines.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        broadcast_checked(starts), ["path", "block"]
    )
    at = F.col("begun") + F.col("before")
    one, two, half = F.xxhash64(at, F.col("h1")), F.xxhash64(F.lit(1), at, F.col("h2")), (1 << 32) - 1
    parts = [one.bitwiseAND(half), F.shiftrightunsigned(one, 32), two.bitwiseAND(half), F.shiftrightunsigned(two, 32)]
    sums = placed.groupBy("path", F.floor(at / range_bytes).cast("long").alias("range_number")).agg(
        *[F.sum(p).alias(f"s{k}") for k, p in enumerate(parts)], F.count(F.lit(1)).alias("n")
    )
    text = F.concat_ws(":", "n", *[f"s{k}" for k in range(len(parts))])
    return sums.select("path", "range_number", (F.col("range_number") * range_bytes).alias("start_byte"), F.sha2(text, 256).alias("digest"))


def file_checksums(ranges: DataFrame, listing: DataFrame) -> DataFrame:
    """``path, size_bytes, checksum`` of the files of a listing (``file_listing``, which leaves empty files out)."""
    leaves = ranges.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("range_number", "digest"))).alias("leaves"))
    joined = listing.select("path", "size_bytes").join(leaves, "path", "left")
    text = F.array_join(F.coalesce(F.transform("leaves", lambda r: r["digest"]), F.array().cast("array<string>")), "")
    return joined.select("path", "size_bytes", F.sha2(F.concat_ws("#", F.col("size_bytes").cast("string"), text), 256).alias("checksum"))


def changed_ranges(current: DataFrame, registered: DataFrame) -> DataFrame:
    """Ranges that differ: ``path, range_number, start_byte`` and ``CHANGED``, ``MISSING`` or ``NEW``."""
    keys = ["path", "range_number", "start_byte"]
    old, now = (df.select(*keys, F.col("digest").alias(n)) for df, n in ((registered, "old"), (current, "now")))
    joined = old.join(now, keys, "full_outer").where(~F.col("old").eqNullSafe(F.col("now")))
    kind = F.when(F.col("now").isNull(), "MISSING").when(F.col("old").isNull(), "NEW").otherwise("CHANGED")
    return joined.select(*keys, kind.alias("drift"))
