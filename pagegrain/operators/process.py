"""Typed pass: one projection whose rule per column follows from the column name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain import fixed_values as fixed
from pagegrain.functions import text as texts
from pagegrain.functions import values
from pagegrain.functions.shown import as_text

METADATA = "_metadata"


def rule_for(name: str, dtype: T.DataType) -> str:
    """Rule of a field: price, date, text, url, rating, list, strip or keep."""
    low = name.lower()
    for rule, fragments in fixed.FIELD_RULES:
        if any(fragment in low for fragment in fragments):
            return rule
    if isinstance(dtype, T.ArrayType):
        return "list"
    return "strip" if isinstance(dtype, T.StringType) else "keep"


def process_field(name: str, value: Column, dtype: T.DataType) -> Column:
    """The rule of ``name`` applied to a column of type ``dtype``; null stays null."""
    rule = rule_for(name, dtype)
    is_text = isinstance(dtype, T.StringType)
    if rule in ("price", "rating"):
        if isinstance(dtype, (T.NumericType, T.BooleanType)):
            return value.cast("double")
        if not is_text:
            return F.lit(None).cast("double")
        return values.parse_price(value) if rule == "price" else values.parse_rating(value)
    if rule in ("date", "text", "url"):
        if not is_text:
            return as_text(value, dtype)
        return {
            "date": values.parse_date,
            "text": texts.normalise_text,
            "url": values.with_scheme,
        }[rule](value)
    if rule == "list":
        return F.transform(value, lambda item: process_field(f"{name}_item", item, dtype.elementType))
    return texts.strip(value) if rule == "strip" else value


def metadata(processed_at: str | None = None) -> Column:
    """Processing stamp; pass ``processed_at`` for a repeatable run."""
    stamp = F.lit(processed_at) if processed_at else F.date_format(
        F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    )
    return F.struct(
        stamp.alias("processed_at"), F.lit(fixed.PROCESSOR_VERSION).alias("processor_version")
    )


def process_records(
    records: DataFrame,
    processed_at: str | None = None,
    keep: tuple[str, ...] = (),
    stamp: bool = True,
) -> DataFrame:
    """Apply every column's rule in one projection and add ``_metadata``.

    Columns in ``keep`` (keys, order columns) pass through as they are.
    """
    columns = [
        F.col(f"`{f.name}`")
        if f.name in keep
        else process_field(f.name, F.col(f"`{f.name}`"), f.dataType).alias(f.name)
        for f in records.schema
    ]
    if stamp:
        columns.append(metadata(processed_at).alias(METADATA))
    return records.select(*columns)
