"""Helpers the operators share: tables, stored intermediate tables, texts as byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.storage import scratch_path

#: Bytes of text one step of a vectorised helper works on; a longer single text is one step.
STEP_BYTES = 1 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs no replay.

    Shuffle files of the write are removed when it is done; the table stands for them.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column | str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % of


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins (one more entry than texts); nulls are empty."""
    texts = pa.array(texts.to_pylist(), pa.large_string()) if texts.offset else texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into runs of rows with about STEP_BYTES of text; yields rows, bytes and offsets from 0."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1
            end = min(batch.num_rows, max(end, at + 1))
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def spans_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay within one text."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(len(mask), bool)
    first[0] = True
    np.logical_not(mask[:-1], out=first[1:])
    cuts = offsets[(offsets > 0) & (offsets < len(mask))]
    first[cuts] = True
    last = np.empty(len(mask), bool)
    last[-1] = True
    np.logical_not(mask[1:], out=last[:-1])
    last[cuts - 1] = True
    return np.flatnonzero(mask & first), np.flatnonzero(mask & last) + 1


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
