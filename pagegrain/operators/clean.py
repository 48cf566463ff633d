"""Cleaning: strings at any depth, empties, field names and single-purpose cleaners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain import fixed_values as fixed
from pagegrain.functions import text as texts
from pagegrain.functions import values
from pagegrain.functions.shown import as_text


def _has_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_text(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_text(f.dataType) for f in dtype)
    if isinstance(dtype, T.MapType):
        return _has_text(dtype.valueType)
    return isinstance(dtype, T.StringType)


def _drop_empty(value: Column, dtype: T.DataType) -> Column:
    """Collapse strings and turn empty strings, lists, maps and structs into null, bottom up."""
    if isinstance(dtype, T.StringType):
        return F.nullif(texts.collapse(value), F.lit(""))
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        if isinstance(inner, (T.StringType, T.ArrayType, T.StructType, T.MapType)):
            # A null list element that was null before is kept, an emptied one goes.
            pairs = F.transform(
                value,
                lambda item: F.struct(item.isNull().alias("was"), _drop_empty(item, inner).alias("now")),
            )
            kept = F.filter(pairs, lambda pair: pair["was"] | pair["now"].isNotNull())
            value = F.transform(kept, lambda pair: pair["now"])
        return F.when(F.size(value) > 0, value)
    if isinstance(dtype, T.MapType):
        inner = dtype.valueType
        if isinstance(inner, (T.StringType, T.ArrayType, T.StructType, T.MapType)):
            # Emptied entries go; those under a ``_`` key, and those null before, stay.
            def kept(key: Column, item: Column) -> Column:
                return key.cast("string").startswith("_") | item.isNull()

            pairs = F.transform_values(
                value,
                lambda key, item: F.struct(
                    kept(key, item).alias("kept"),
                    F.when(kept(key, item), item).otherwise(_drop_empty(item, inner)).alias("now"),
                ),
            )
            left = F.map_filter(pairs, lambda _, pair: pair["kept"] | pair["now"].isNotNull())
            value = F.transform_values(left, lambda _, pair: pair["now"])
        return F.when(F.size(value) > 0, value)
    if isinstance(dtype, T.StructType):
        fields = {
            f.name: value[f.name] if f.name.startswith("_") else _drop_empty(value[f.name], f.dataType)
            for f in dtype
        }
        some = reduce(lambda a, b: a | b, [field.isNotNull() for field in fields.values()])
        return F.when(some, F.struct(*[field.alias(name) for name, field in fields.items()]))
    return value


def clean_value(name: str, value: Column, dtype: T.DataType) -> Column:
    """Clean one field; ``_`` fields and values without text stay as they are."""
    if name.startswith("_"):
        return value
    if isinstance(dtype, T.StringType):
        return F.nullif(texts.clean_string(value), F.lit(""))
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        if _has_text(dtype):
            value = texts.clean_nested(value, dtype)
        return _drop_empty(value, dtype)
    return value


def clean_fields(records: DataFrame) -> DataFrame:
    """Clean every string at any depth; emptied values become null."""
    return records.select(
        *[clean_value(f.name, F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in records.schema]
    )


def drop_empty_rows(records: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Drop rows in which every column (but those in ``ignore``) is null."""
    tests = [F.col(f"`{name}`").isNotNull() for name in records.columns if name not in ignore]
    return records.where(reduce(lambda a, b: a | b, tests)) if tests else records


def standard_names(fields: list[str]) -> dict[str, str]:
    """Variant field -> standard name, skipped where the standard name is itself a field.

    Spark tells no column names apart by case, so a field that is the standard name in
    another case counts as one of its variants and meets the others in one column.
    """
    mapping = {}
    for standard, variants in fixed.STANDARD_FIELDS.items():
        if standard in fields:
            continue
        names = {standard, *variants}
        mapping.update({field: standard for field in fields if field.lower() in names and field not in mapping})
    return mapping


def standardise_fields(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename variants to standard names; of two variants the later column wins where set."""
    mapping = standard_names([name for name in records.columns if name not in keep])
    sources: dict[str, list[str]] = {}
    for name in records.columns:
        sources.setdefault(mapping.get(name, name), []).insert(0, name)
    return records.select(
        *[first_set(records, names).alias(target) for target, names in sources.items()]
    )


def first_set(records: DataFrame, names: list[str]) -> Column:
    """First non-null of the columns; columns of different types meet as text, as Python prints it."""
    columns = [F.col(f"`{name}`") for name in names]
    kinds = [records.schema[name].dataType for name in names]
    if len({kind.simpleString() for kind in kinds}) > 1:
        columns = [as_text(column, kind) for column, kind in zip(columns, kinds)]
    return F.coalesce(*columns) if len(columns) > 1 else columns[0]


def clean_records(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Clean values, drop empty rows, standardise names. ``keep`` columns pass through.

    Kept columns do not count as content; ``_metadata`` does.
    """
    cleaned = records.select(
        *[
            F.col(f"`{f.name}`")
            if f.name in keep
            else clean_value(f.name, F.col(f"`{f.name}`"), f.dataType).alias(f.name)
            for f in records.schema
        ]
    )
    return standardise_fields(drop_empty_rows(cleaned, keep), keep)


def remove_empty_fields(
    records: DataFrame, keep: tuple[str, ...] = (), drop_columns: bool = False
) -> DataFrame:
    """Blank strings and empty lists become null; rows with nothing left go.

    ``drop_columns`` also removes columns that are null everywhere, at the cost of
    one pass that counts the non-null values of each column.
    """

    def emptied(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if field.name in keep:
            return value
        if isinstance(field.dataType, T.StringType):
            return F.when(texts.strip(value) != "", value)
        if isinstance(field.dataType, (T.ArrayType, T.MapType)):
            return F.when(F.size(value) > 0, value)
        return value

    rows = drop_empty_rows(records.select(*[emptied(f).alias(f.name) for f in records.schema]), keep)
    if not drop_columns:
        return rows
    counts = rows.agg(*[F.count(f"`{name}`").alias(name) for name in rows.columns]).first()
    return rows.select(*[f"`{name}`" for name in rows.columns if name in keep or counts[name]])


def _on_text_fields(records: DataFrame, fields: list[str], change) -> DataFrame:
    text = {f.name for f in records.schema if isinstance(f.dataType, T.StringType)}
    return records.withColumns(
        {name: change(F.col(f"`{name}`")) for name in fields if name in text}
    )


def normalise_case(records: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return _on_text_fields(records, fields or fixed.TITLE_FIELDS, texts.title_case)


def clean_urls(records: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return _on_text_fields(
        records,
        fields or fixed.URL_FIELDS,
        lambda value: values.escape_spaces(values.with_scheme(value)),
    )


def clean_html_fields(records: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return _on_text_fields(records, fields or fixed.HTML_FIELDS, texts.clean_html)


def clean_prices(records: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Prices as numbers with two decimals.

    A text that holds no number has no place in a numeric column: it stays in
    ``<field>_raw``, which is null where the price was parsed.
    """
    changed = {}
    for field in fields or fixed.PRICE_FIELDS:
        if field not in records.columns:
            continue
        value, dtype = F.col(f"`{field}`"), records.schema[field].dataType
        if isinstance(dtype, (T.NumericType, T.BooleanType)):
            changed[field] = values.round_cents(value.cast("double"))
        elif isinstance(dtype, T.StringType):
            price = values.parse_price(value)
            changed[field] = values.round_cents(price)
            changed[f"{field}_raw"] = F.when(price.isNull(), value)
    return records.withColumns(changed)
