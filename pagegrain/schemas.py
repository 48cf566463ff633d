"""Schemas of the stored tables."""

from pyspark.sql import types as T

SELECTOR = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("selector", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("attribute", T.StringType()),
        T.StructField("multiple", T.BooleanType()),
        T.StructField("post_processing", T.StringType()),
        T.StructField("container", T.BooleanType()),
    ]
)
PAGINATION = T.StructType(
    [
        T.StructField("selector", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("parameter", T.StringType()),
    ]
)
METADATA = T.StructType(
    [
        T.StructField("generated_at", T.DoubleType()),
        T.StructField("url", T.StringType()),
        T.StructField("data_description", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("refined", T.BooleanType()),
        T.StructField("feedback", T.StringType()),
        T.StructField("original_selectors", T.ArrayType(SELECTOR)),
    ]
)
CONFIG = T.StructType(
    [
        T.StructField("selectors", T.ArrayType(SELECTOR)),
        T.StructField("pagination", PAGINATION),
        T.StructField("metadata", METADATA),
    ]
)
CATALOGUE = T.StructType([T.StructField("task_id", T.StringType()), *CONFIG.fields])
FEEDBACK = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("data_description", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("feedback", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
    ]
)
PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
