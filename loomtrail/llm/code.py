"""This package's code for Python workers that cannot import it by themselves."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="loomtrail-code-")) / "loomtrail_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted((root / "loomtrail").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
