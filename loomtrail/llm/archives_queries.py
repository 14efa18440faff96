"""Query of the archive converter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtrail.llm import archives
from loomtrail.llm.registry import query, table
from loomtrail.scale import staged_path


@query("op13_arc_to_warc")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    arcs = archives.write_arc(table(spark, folder, "pages"), staged_path(spark, "arc"))
    warcs = archives.convert(spark, arcs, staged_path(spark, "warc"))
    return archives.resolved(archives.read_warc(spark, warcs))
