"""Commits as numbered files that are put in place only where none is.

A commit file is written under a name of its own and then renamed to its number without overwriting, which Hadoop's
file systems do in one step. Of two writers of one number one wins, and the other is told. What a
commit names is visible; data written for a commit that never came is not, and can be listed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, SparkSession

try:
    from py4j.protocol import Py4JJavaError
except ImportError:  # a client without a JVM of its own
    Py4JJavaError = PySparkException


class CommitConflict(RuntimeError):
    """Another writer has taken the number."""


def _jvm_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _jvm_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, text: str) -> None:
    """Create a file with this text, or raise ``CommitConflict`` if there is one."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    system, temporary, target = _file_system(spark, path), _jvm_path(spark, own), _jvm_path(spark, path)
    out = system.create(temporary, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    # No options: an existing target is an error.
    options = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    files = hadoop.FileContext.getFileContext(system.getUri(), context._jsc.hadoopConfiguration())
    try:
        files.rename(temporary, target, options)
    except Py4JJavaError as error:
        system.delete(temporary, False)
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()) or system.exists(target):
            raise CommitConflict(path) from None
        raise


def commit(spark: SparkSession, folder: str, number: int, values: dict) -> None:
    put_if_absent(spark, f"{folder}/{number:010d}.json", json.dumps(values | {"number": number}))


def committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One row per commit."""
    system = _file_system(spark, folder)
    if not system.exists(_jvm_path(spark, folder)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(folder)


def folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Folders directly below a path, with the time of their last change in milliseconds."""
    system = _file_system(spark, path)
    if not system.exists(_jvm_path(spark, path)):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in system.listStatus(_jvm_path(spark, path)) if s.isDirectory()]
