"""Readers for raw logs, canonical logs and row numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrail.functions.text import decimal_number, plain_integer
from loomtrail.functions.timestamps import DATE_SHAPE
from loomtrail.operators.normalize import ROW_NUMBER
from loomtrail.scale import DEFAULT_POLICY, ScalePolicy, broadcast_checked, stage, staged_path
from loomtrail.sources import csv_blocks

_ROW_BITS = 33  # monotonically_increasing_id: partition in the high bits, row in the low ones


def read_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """CSV with a header, every column as text. Quotes are doubled inside quoted values.

    Files are split between tasks, also where values hold line breaks (see ``csv_blocks``). One pass over the
    lines tells whether any do; only then are records put together, and kept as a table in the order of files and
    records. Sources known to have none can be read with ``multiline=False``, which spares that pass. A file whose header
    differs from the others' fails.
    """
    folder = _put_together(spark, path) if multiline and csv_blocks.has_line_breaks(spark, path) else None
    return _plain_csv(spark, path) if folder is None else spark.read.parquet(folder)


def read_numbered_csv(spark: SparkSession, path: str) -> DataFrame:
    """``read_csv`` with a contiguous ``source_row_number``; records that were put together are written once only."""
    if csv_blocks.has_line_breaks(spark, path):
        return number_parquet_rows(spark, _put_together(spark, path))
    return number_rows(_plain_csv(spark, path))


def _plain_csv(spark: SparkSession, path: str) -> DataFrame:
    check_header(spark, path)
    return spark.read.option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)


def _put_together(spark: SparkSession, path: str) -> str:
    """The folder of a table of all records, in the order of its files and their rows."""
    every, states = csv_blocks.located(spark, path)
    names = _checked_names(spark, csv_blocks.first_names(every, states))
    rows = csv_blocks.parsed(csv_blocks.put_together(every, states), states, names)
    folder = staged_path(spark, "csv-records")
    rows.drop("_file", "_block", "_id").write.option("compression", "zstd").parquet(folder)
    return folder


def read_csv_gz(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Gzip CSV. One file is one task while reading, so rows are spread right after the scan.

    Spreading loses file order. To number rows, give ``read_csv`` of the same path to
    ``number_rows``: its staged copy can be split again.
    """
    n = partitions or spark.sparkContext.defaultParallelism
    return read_csv(spark, path).repartition(n)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV against an explicit schema; text that does not fit its column becomes NULL."""
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)


def read_json_events(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """JSON events with text timestamps, as an event log: one array per file, or one object per
    line (``multiline=False``), which large files need in order to be split."""
    rows = spark.read.option("multiLine", multiline).json(path)
    return rows.withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz")).withColumn(
        "source_event_id", F.col("event_id")
    )


def check_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first record; repeated names are rejected, as Spark compares names.

    Reading compares the headers of further files with it.
    """
    line = csv_blocks.first_line(spark, path) or ""
    whole = line.count('"') % 2 == 0
    names = csv_blocks.names_in(line) if whole else csv_blocks.first_names(*csv_blocks.located(spark, path))
    return _checked_names(spark, names)


def _checked_names(spark: SparkSession, names: list[str]) -> list[str]:
    if not names:
        raise ValueError("the source has no columns")
    exact = spark.conf.get("spark.sql.caseSensitive") == "true"
    compared = names if exact else [n.lower() for n in names]
    repeated = sorted({n for n, c in zip(names, compared) if compared.count(c) > 1})
    if repeated:
        raise ValueError(f"repeated column names: {repeated}")
    return names


def _type_tests(text: Column) -> list[tuple[str, Column]]:
    """Types from narrow to wide, each with a value that is NULL where the text does not fit it."""
    whole = plain_integer(text)
    return [
        ("boolean", F.when(F.lower(F.trim(text)).isin("true", "false"), True)),
        ("int", F.when(whole.between(-(1 << 31), (1 << 31) - 1), whole)),
        ("bigint", whole),
        ("double", decimal_number(text)),
        ("date", F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$"), text.try_cast("date"))),
        ("timestamp", F.when(text.rlike(DATE_SHAPE), text.try_cast("timestamp"))),
    ]


def infer_types(rows: DataFrame) -> DataFrame:
    """Narrowest type per text column that fits every value; ``string`` if none.

    Cells are turned into rows, so that the generated code stays small for wide sources. A cell becomes a mask of the
    types it fits, and a column keeps the bits that all its cells share.
    """
    names = rows.columns
    cells = rows.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in names])).alias("at", "text"))
    tests = _type_tests(F.col("text"))
    bits = [F.when(fits.isNotNull(), 1 << k).otherwise(0) for k, (_, fits) in enumerate(tests)]
    masks = cells.where("text is not null").groupBy("at").agg(F.bit_and(sum(bits[1:], bits[0])).alias("mask"))
    fitting = [F.when(F.col("mask").bitwiseAND(1 << k) != 0, kind) for k, (kind, _) in enumerate(tests)]
    # One row per column of the source; an empty source still names its columns.
    listed = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("column_name")) for i, c in enumerate(names)])
    columns = rows.sparkSession.range(1).select(F.inline(listed))
    return columns.join(masks, "at", "left").select(
        (F.col("at") + 1).alias("ordinal_position"),
        "column_name",
        F.coalesce(*fitting, F.lit("string")).alias("inferred_type"),
    )


def detect_schema(spark: SparkSession, path: str, file_type: str) -> DataFrame:
    """Type per column: ``ordinal_position, column_name, inferred_type``. Parquet states its types."""
    if file_type != "PARQUET":
        return infer_types(read_csv(spark, path))
    fields = spark.read.parquet(path).schema.fields
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields, 1)]
    return spark.createDataFrame(rows, "ordinal_position int, column_name string, inferred_type string")


def number_parquet_rows(spark: SparkSession, path: str, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Parquet rows with a contiguous ``source_row_number`` in file order.

    The reader knows the row's index in its file, so only one offset per file is needed. Nothing
    is sorted and no data column is read for the offsets.
    """
    rows = spark.read.parquet(path)
    numbered = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    along = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    offsets = (
        numbered.groupBy("_file")
        .agg((F.max("_at") + 1).alias("_rows"))
        .select("_file", F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_before"))
    )
    return (
        numbered.join(broadcast_checked(offsets, policy), "_file")
        .withColumn(ROW_NUMBER, F.col("_before") + F.col("_at") + 1)
        .drop("_file", "_at", "_before")
    )


def number_rows(rows: DataFrame, policy: ScalePolicy = DEFAULT_POLICY) -> DataFrame:
    """Contiguous ``source_row_number`` for sources without a row index, such as CSV.

    The rows are staged once with their position, which also parses the text only once and fixes
    the numbering; offsets then make the numbers contiguous: per block of a file, in the order of files
    and blocks, where ``rows`` come straight from files, else per read partition.
    """
    try:
        placed = rows.select(
            "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
        )
    except AnalysisException:
        part = F.shiftright(F.monotonically_increasing_id(), _ROW_BITS)
        placed = rows.withColumns({"_file": F.lit(""), "_block": part})
    staged = stage(placed.withColumn("_id", F.monotonically_increasing_id()), "numbered-rows")
    along = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)  # one row per block
    offsets = (
        staged.groupBy("_file", "_block")
        .agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
        .select("_file", "_block", "_first", F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_before"))
    )
    return (
        staged.join(broadcast_checked(offsets, policy), ["_file", "_block"])
        .withColumn(ROW_NUMBER, F.col("_before") + F.col("_id") - F.col("_first") + 1)
        .drop("_id", "_file", "_block", "_first", "_before")
    )


@dataclass(frozen=True)
class EventSource:
    """An event relation and where it came from."""

    events: DataFrame
    signature: str = "all-events"
    mapping_version: str = "all"
    dataset_id: str | None = None
    contract_version: str | None = None
    activity_mapping_version: str | None = None
    normalization_version: str | None = None
    activity_level: str = "source"


def default_source(events: DataFrame) -> EventSource:
    """A plain log: its event ids are the source's own."""
    return EventSource(events.withColumn("source_event_id", F.col("event_id")))


def normalized_source(
    spark: SparkSession, path: str, dataset_id: str, mapping_version: int, contract_version: int | None = None
) -> EventSource:
    return EventSource(
        events=spark.read.parquet(path),
        signature=f"dataset={dataset_id}",
        mapping_version=f"mapping-v{mapping_version}",
        dataset_id=dataset_id,
        contract_version=None if contract_version is None else f"contract-v{contract_version}",
        normalization_version="event-log-v1",
    )


def provenance(source: EventSource) -> DataFrame:
    """One row that tells what a result was computed from, with the number of events."""
    return source.events.agg(F.count("*").alias("event_count")).select(
        "event_count",
        *[
            F.lit(value).cast("string").alias(name)
            for name, value in (
                ("signature", source.signature),
                ("mapping_version", source.mapping_version),
                ("dataset_id", source.dataset_id),
                ("contract_version", source.contract_version),
                ("activity_mapping_version", source.activity_mapping_version),
                ("normalization_version", source.normalization_version),
                ("activity_level", source.activity_level),
            )
        ],
    )
