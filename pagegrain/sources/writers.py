"""Sinks: CSV, JSON, several formats at once, exact chunks."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain.functions.shown import as_text
from pagegrain.operators.records import with_chunks
from pagegrain.storage import remove_scratch, scratch_path

log = logging.getLogger(__name__)

#: Files that ``write_each`` lays into a folder, about.
SHELF = 250


def csv_columns(records: DataFrame) -> list[Column]:
    """Columns in name order, nested values as JSON text."""
    types = {f.name: f.dataType for f in records.schema}

    def column(name: str) -> Column:
        value = F.col(f"`{name}`")
        if isinstance(types[name], (T.ArrayType, T.StructType, T.MapType)):
            value = F.to_json(value, {"ignoreNullFields": "false"})
        elif isinstance(types[name], (T.BooleanType, T.DoubleType, T.FloatType)):
            value = as_text(value, types[name])
        return value.alias(name)

    return [column(name) for name in sorted(types)]


CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "encoding": "UTF-8",
}
JSON_OPTIONS = {"ignoreNullFields": False}


def write_csv(records: DataFrame, path: str, mode: str = "errorifexists", **options) -> str:
    """CSV with a header; columns sorted by name, null as an empty field, spaces kept."""
    ready = records.select(*csv_columns(records))
    ready.write.mode(mode).options(**CSV_OPTIONS, **options).csv(path)
    return path


def write_json(records: DataFrame, path: str, mode: str = "errorifexists", **options) -> str:
    """One JSON object per line, null fields written, non-ASCII text as it is."""
    records.write.mode(mode).options(**JSON_OPTIONS, **options).json(path)
    return path


def write_each(texts: DataFrame, path: str, **options) -> str:
    """A file for each row of a table of one text column, in folders ``shelf=<n>`` of about ``SHELF`` files.

    A task fills a folder of its own, which moves into place as one. All file names differ. ``readers.by_shelf``
    lists some folders at a time, where one folder of all files would fill the driver's memory.
    """
    shelves = max(-(-texts.count() // SHELF), texts.sparkSession.sparkContext.defaultParallelism)
    dealt = texts.repartition(shelves).withColumn("shelf", F.spark_partition_id())
    dealt.write.options(maxRecordsPerFile=1, **options).partitionBy("shelf").text(path)
    return path


FORMATS = {"csv": write_csv, "json": write_json}


def export(records: DataFrame, path: str, format_type: str = "csv", mode: str = "errorifexists") -> str:
    """Write in the named format, whatever its case; an unknown one falls back to CSV.

    An empty table still leaves a readable output: a header, or no JSON lines.
    """
    return FORMATS.get(format_type.lower(), write_csv)(records, path, mode)


def export_formats(records: DataFrame, folder: str, formats: list[str] = ("csv", "json")) -> dict[str, str]:
    """Write several formats; unknown ones are skipped.

    The records are computed once, into a table in the shared folder that every format is written
    from and that goes when they are, so all formats hold the same rows and stamps. A format that
    fails is logged and does not stop the others.
    """
    wanted = []
    for name in dict.fromkeys(f.lower() for f in formats):
        if name in FORMATS:
            wanted.append(name)
        else:
            log.warning("format %s is not supported, skipped", name)
    if not wanted:
        return {}
    spark, path = records.sparkSession, scratch_path(records.sparkSession, "formats")
    written = {}
    try:
        records.write.parquet(path)
        once = spark.read.schema(records.schema).parquet(path)
        for name in wanted:
            try:
                written[name] = FORMATS[name](once, f"{folder}/{name}")
            except Exception:
                log.exception("export to %s failed", name)
    finally:
        remove_scratch(spark, path)
    return written


def export_chunks(
    records: DataFrame,
    folder: str,
    *order_by: str,
    chunk_size: int = 1000,
    format_type: str = "csv",
    with_count: bool = False,
) -> str:
    """Groups of exactly ``chunk_size`` consecutive rows, each one file in ``chunk=<n>``.

    With ``with_count`` the path also says of how many: ``chunks=<of>/chunk=<n>``.

    The shuffle that numbers the rows already brings whole chunks to one task, which
    writes them in order.
    """
    path = ("chunks", "chunk") if with_count else ("chunk",)
    chunks = with_chunks(records, chunk_size, *order_by, name="chunk", count="chunks" if with_count else None)
    ordered = chunks.sortWithinPartitions(*path, *order_by)
    if format_type.lower() == "json":
        ordered.write.options(**JSON_OPTIONS).partitionBy(*path).json(folder)
    else:
        ready = ordered.select(*csv_columns(records), *path)
        ready.write.options(**CSV_OPTIONS).partitionBy(*path).csv(folder)
    return folder


def export_parts(records: DataFrame, folder: str, chunk_size: int = 1000, format_type: str = "csv") -> str:
    """Files of at most ``chunk_size`` rows, without a shuffle and without exact numbering."""
    write = FORMATS.get(format_type.lower(), write_csv)
    return write(records, folder, maxRecordsPerFile=chunk_size)
