"""Scans: stored pages, selector catalogue, feedback, scraped records, plain JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain import schemas
from pagegrain.storage import scratch_path

BAD = "_corrupt_record"
#: Folders that ``by_shelf`` reads at once; over ``spark.sql.sources.parallelPartitionDiscovery.threshold``, so that tasks list them.
SHELVES_AT_ONCE = 40
#: Size of the session's cache of file listings, which would outlive each read.
LISTINGS = "spark.sql.hive.filesourcePartitionFileCacheSize"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def by_shelf(spark: SparkSession, path: str, read: Callable[[list[str]], DataFrame]) -> DataFrame:
    """Rows of ``read(folders)`` over a folder of files, or over its folders ``shelf=<n>`` where it has any.

    The driver holds the names of all files that a read covers, and plans a task for every few small
    ones. So shelves (see ``writers.write_each``) are read some at a time, by a few tasks, and their rows are
    stored, before this returns; a folder without shelves is one lazy read.
    """
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path, "shelf=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    shelves = sorted(status.getPath().toString() for status in found or [] if status.isDirectory())
    if not shelves:
        return read([path])
    stored, tasks = scratch_path(spark, "shelves"), 2 * spark.sparkContext.defaultParallelism
    kept = spark.conf.get(LISTINGS, None)
    spark.conf.set(LISTINGS, 0)
    try:
        for at in range(0, len(shelves), SHELVES_AT_ONCE):
            rows = read(shelves[at : at + SHELVES_AT_ONCE])
            rows.coalesce(tasks).write.mode("append").parquet(stored)
    finally:
        spark.conf.unset(LISTINGS) if kept is None else spark.conf.set(LISTINGS, kept)
    return spark.read.schema(rows.schema).parquet(stored)


def read_json(
    spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    """JSON files under a fixed schema; an unreadable file or row leaves its text in ``_corrupt_record``.

    ``multi_line`` reads one document or array per file, otherwise one per line.
    """
    return (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(BAD, T.StringType())]))
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .json(path)
    )


def read_catalogue(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Selector configs by task.

    A folder of ``<task>.json`` files, where an unreadable file is a task without a
    config, or shelves of them (see ``by_shelf``); with ``lines``, files of many JSON lines
    that carry their ``task_id``.
    """
    if lines:
        return read_json(spark, path, schemas.CATALOGUE, multi_line=False).drop(BAD)
    name = F.regexp_replace("_metadata.file_name", r"\.json\z", "")
    return by_shelf(
        spark, path, lambda folders: read_json(spark, folders, schemas.CONFIG).select(name.alias("task_id"), *schemas.CONFIG.names)
    )


def read_feedback(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Feedback rows; a bad file costs its own row only (text in ``_corrupt_record``)."""
    return read_json(spark, path, schemas.FEEDBACK, multi_line=not lines)


def read_records(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    """Scraped records (an array per file, or a record per line); a missing path gives no rows.

    Unreadable files and lines are no records; ``read_bad_records`` lists them.
    """
    try:
        rows = read_json(spark, path, schema, multi_line)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.where(F.col(BAD).isNull()).drop(BAD)


def read_bad_records(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    """``file, text`` of what ``read_records`` could not read."""
    rows = read_json(spark, path, schema, multi_line)
    # Spark refuses to read the text of bad rows alone, so the parsed columns are part of it.
    parsed = F.to_json(F.struct(*[f"`{name}`" for name in schema.names]))
    text = F.coalesce(F.col(BAD), F.concat(F.lit("\x00"), parsed))
    return rows.select(F.col("_metadata.file_name").alias("file"), text.alias("text")).where(~F.col("text").startswith("\x00"))
