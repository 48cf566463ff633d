"""Shared folders: where lineage is cut and where scratch tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="pagegrain-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch table whose results are stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Checkpoint into the shared folder, so that a lost executor costs no replay."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager)


def text_bytes(df: DataFrame) -> int:
    """Size of a narrow table as JSON text; one row reaches the driver."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    return df.agg(F.coalesce(size, F.lit(0)).alias("bytes")).first()["bytes"]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES, size: int | None = None) -> DataFrame:
    """Mark a narrow table, cheap to compute again, for broadcast if it measures at most ``limit``.

    For joins against page markup: the size is known before the join is planned, so
    a small table never makes Spark shuffle the markup. A larger one joins as usual.
    """
    return F.broadcast(df) if (text_bytes(df) if size is None else size) <= limit else df
