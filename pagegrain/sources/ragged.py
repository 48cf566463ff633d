"""Records of unknown, differing shape: one pass finds the union of their keys, another gives typed columns.

Each record is kept as a VARIANT, in which a key that is not there differs from one that holds null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "record"
BAD = "_corrupt_record"


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """``record, _corrupt_record``: one JSON object per line; any other line leaves its text beside a null record."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    record = F.when(F.ltrim("value").startswith("{"), F.try_parse_json("value"))
    return lines.select(record.alias(RECORD), F.when(record.isNull(), F.col("value")).alias(BAD))


def observed_schema(records: DataFrame, record: str = RECORD) -> T.StructType:
    """The union of all keys with a type that holds every value met; keys with values of several kinds are texts.

    Each task folds its rows, so the driver gets one schema.
    """
    text = records.select(F.schema_of_variant_agg(F.col(record)).alias("shape")).first()["shape"]
    if text is None or not text.startswith("OBJECT"):
        return T.StructType([])
    shape = T._parse_datatype_string(_ddl(text))
    return T.StructType([T.StructField(f.name, f.dataType) for f in shape])


def _ddl(text: str) -> str:
    """Spark's words for the shape of a variant as those of a table's; what has no one type is text. Names stay."""
    words = {"OBJECT": "STRUCT", "VARIANT": "STRING", "VOID": "STRING"}
    found = r"`(?:[^`]|``)*`|(?:^|(?<=: )|(?<=ARRAY<))(OBJECT|VARIANT|VOID)\b"
    return re.sub(found, lambda m: words[m[1]] if m[1] else m[0], text)


def is_there(name: str, record: str = RECORD) -> Column:
    """Whether a record has the key at all, whatever it holds."""
    return F.coalesce(F.variant_get(F.col(record), _path(name), "variant").isNotNull(), F.lit(False))


def _path(name: str) -> str:
    quote = "'" if "'" not in name else '"'
    return f"$[{quote}{name}{quote}]"


def with_fields(records: DataFrame, schema: T.StructType, record: str = RECORD, absent: str | None = None) -> DataFrame:
    """Typed columns in place of the record; a value that doesn't fit its type is null.

    ``absent`` names a column for the keys a record does not have, in the schema's order.
    """
    values = [F.try_variant_get(F.col(record), _path(f.name), f.dataType.simpleString()).alias(f.name) for f in schema]
    others = [F.col(f"`{name}`") for name in records.columns if name != record]
    missing = F.filter(F.array(*[F.when(~is_there(f.name, record), F.lit(f.name)) for f in schema]).cast("array<string>"), lambda name: name.isNotNull())
    return records.select(*others, *values, *([missing.alias(absent)] if absent else []))
