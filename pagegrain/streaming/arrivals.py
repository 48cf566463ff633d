"""Feedback and pages arriving as files, appended to tables with Structured Streaming.

Users rate one result at a time and pages are stored one after another, so both
tables grow by small files. Each job takes what is new since its checkpoint, runs
the row-wise batch operators on it and stops; no state is kept between rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagegrain import schemas
from pagegrain.operators.feedback import new_feedback
from pagegrain.plans.jobs import scrape

ENTRY = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("data_description", T.StringType()),
        T.StructField("rating", T.StringType()),
        T.StructField("feedback", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
    ]
)


def _append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def append_new_feedback(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Rating files (one JSON document each) into the feedback table."""
    entries = spark.readStream.schema(ENTRY).option("multiLine", True).json(folder)
    return _append(new_feedback(entries), table, checkpoint)


def append_new_records(
    spark: SparkSession, folder: str, config: dict, table: str, checkpoint: str
) -> StreamingQuery:
    """New page files into a table of clean typed records."""
    pages = spark.readStream.schema(schemas.PAGES).parquet(folder)
    return _append(scrape(pages, config), table, checkpoint)
