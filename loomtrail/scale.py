"""What depends on data size: group bounds, broadcasts and staged tables.

An operator that gathers a group (a case, an edge, a duplicate key) in one task counts the rows of its
groups first. Groups above ``max_group_rows`` are split; the others are gathered. Nothing is decided
by estimates of sizes.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScalePolicy:
    """Bounds of one task."""

    max_group_rows: int = 2_000_000
    broadcast_bytes: int = 64 << 20

    def __post_init__(self) -> None:
        if self.max_group_rows < 1:
            raise ValueError("max_group_rows must be positive")


DEFAULT_POLICY = ScalePolicy()

#: What a row of a broadcast takes beside its values.
HELD_ROW_BYTES = 64

#: Operators that may give out more bytes than they read; no estimate bounds what is above them.
_MULTIPLYING = ("Generate", "Join", "Expand", "MapInPandas", "MapInArrow", "FlatMap")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_checked(df: DataFrame, policy: ScalePolicy = DEFAULT_POLICY, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only of a table within the bound, or of a part or an aggregate of one; with ``rows``, where they
    have been counted, of so many rows as they are in memory.

    Otherwise the join stays a shuffle join; adaptive execution may still turn it into a broadcast
    once it has seen the real size.
    """
    if rows is not None:
        width = int(df._jdf.schema().defaultSize()) + HELD_ROW_BYTES
        return F.broadcast(df) if rows * width <= policy.broadcast_bytes else df
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(name in plan for name in _MULTIPLYING) or plan_bytes(df) > policy.broadcast_bytes:
        return df
    return F.broadcast(df)


_own_folders: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Named by ``spark.checkpoint.dir`` or set with ``setCheckpointDir``. Only a local session, whose one
    process is driver and executor, may go without: it gets a scratch folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("executors need a shared folder: set spark.checkpoint.dir")
    app = context.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="loomtrail-")
        atexit.register(shutil.rmtree, _own_folders[app], ignore_errors=True)
    return _own_folders[app]


def staged_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/loomtrail/{app}/{label}-{uuid.uuid4().hex}"
    for paths in _scopes[-1:]:
        paths.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back, so that later consumers do not recompute
    and a lost executor costs a re-read only."""
    path = staged_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged within, at the end: write or collect what you need inside."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        context = spark.sparkContext
        for path in paths:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
