"""Relational operators on record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain import fixed_values as fixed
from pagegrain.functions.shown import as_text
from pagegrain.operators.clean import first_set
from pagegrain.storage import cut_lineage


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def consolidate_fields(
    records: DataFrame,
    mapping: dict[str, list[str]] | None = None,
    keep: tuple[str, ...] = (),
    types: dict[str, str] | None = None,
) -> DataFrame:
    """Target field = first non-null of its sources in list order; sources go away.

    Sources of different types meet as text; ``types`` names a target's type instead,
    and a source value that doesn't fit it counts as null.

    Fields no target uses pass through; one with a target's own name goes before it.
    A target none of whose sources exists is left out.
    """
    mapping = mapping or fixed.CONSOLIDATE_FIELDS
    used = {source for sources in mapping.values() for source in sources} - set(keep)
    columns = {}
    for target, sources in mapping.items():
        present = [name for name in sources if name in records.columns and name not in keep]
        if present:
            if types and target in types:
                columns[target] = F.coalesce(*[_quoted(name).try_cast(types[target]) for name in present]).alias(target)
            else:
                columns[target] = first_set(records, present).alias(target)
    for name in records.columns:
        if name not in used:
            value = _quoted(name)
            columns[name] = F.coalesce(value, columns[name]).alias(name) if name in columns else value
    return records.select(*columns.values())


def guess_keys(columns: list[str]) -> list[str]:
    """Key columns of a record table by name: url, id, title with price, else all."""
    for name in ("url", "id"):
        if name in columns:
            return [name]
    if "title" in columns and "price" in columns:
        return ["title", "price"]
    return list(columns)


def _ordered(value: Column, dtype: T.DataType) -> Column:
    """A nested value with every map as its entries in order of key, so that equal maps are equal."""
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(e["key"].alias("key"), _ordered(e["value"], dtype.valueType).alias("value")),
        )
        return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: _ordered(item, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [_ordered(value[f.name], f.dataType).alias(f.name) for f in dtype]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    return value


def remove_duplicates(
    records: DataFrame,
    order_by: str,
    keys: list[str] | None = None,
    string_key: bool = False,
) -> DataFrame:
    """First record per key in the order of ``order_by``, which should be unique.

    Asking a rank for its first row lets Spark thin each task's rows to one per key
    before the shuffle (``WindowGroupLimit`` in the plan), so a key that holds a
    third of all rows costs one row per task. ``string_key`` compares keys as
    joined text, so that ``1`` equals ``'1'``. Maps are equal whatever the order of
    their entries.
    """
    names = keys or guess_keys([name for name in records.columns if name != order_by])
    parts = []
    for name in names:
        dtype = records.schema[name].dataType
        if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
            parts.append(F.to_json(_ordered(_quoted(name), dtype)))
        else:
            parts.append(as_text(_quoted(name), dtype) if string_key else _quoted(name))
    if string_key:
        parts = [F.concat_ws("|", *[F.coalesce(part, F.lit("None")) for part in parts])]
    return first_per_key(records, parts, [_quoted(order_by)])


def first_per_key(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _fits(condition, dtype: T.DataType) -> bool:
    if isinstance(condition, bool):
        return isinstance(dtype, T.BooleanType)
    if isinstance(condition, (int, float)):
        return isinstance(dtype, T.NumericType)
    return isinstance(dtype, T.StringType)


def filter_records(records: DataFrame, conditions: dict) -> DataFrame:
    """Rows that meet every condition.

    A plain value asks for equality; a dict may hold ``min`` and ``max`` (both
    inclusive), ``contains`` and ``regex``. A field that is not a column, like a
    null, matches nothing. A bound of another type than its column raises, and so
    does equality between a text and a date or time, which could never match.
    """
    tests: list[Column] = []
    for name, condition in conditions.items():
        if name not in records.columns:
            tests.append(F.lit(False))
            continue
        value, dtype = _quoted(name), records.schema[name].dataType
        if isinstance(condition, str) and isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise TypeError(f"text {condition!r} does not fit column {name!r} of type {dtype.simpleString()}")
        if isinstance(condition, (str, int, float)):
            tests.append(value == F.lit(condition) if _fits(condition, dtype) else F.lit(False))
            continue
        tests.append(value.isNotNull())
        if not isinstance(condition, dict):
            continue
        for bound in ("min", "max"):
            if bound in condition:
                limit = condition[bound]
                if not _fits(limit, dtype):
                    raise TypeError(f"{bound} {limit!r} does not fit column {name!r}")
                tests.append(value >= limit if bound == "min" else value <= limit)
        if "contains" in condition:
            tests.append(as_text(value, dtype).contains(condition["contains"]))
        if "regex" in condition:
            tests.append(as_text(value, dtype).rlike(condition["regex"]))
    return records.where(reduce(lambda a, b: a & b, tests)) if tests else records


def sort_records(
    records: DataFrame, sort_by: str, ascending: bool = True, order_by: str | None = None
) -> DataFrame:
    """Sort by one field, text without regard to case, nulls last either way.

    ``order_by`` breaks ties; with it the range partitioning can also split a
    value, or the nulls, when one of them holds a large part of the rows.
    """
    if sort_by not in records.columns:
        return records
    value = _quoted(sort_by)
    if isinstance(records.schema[sort_by].dataType, T.StringType):
        value = F.lower(value)
    first = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return records.orderBy(first, *([_quoted(order_by).asc()] if order_by else []))


def top_records(records: DataFrame, by: str, limit: int, tie: str) -> DataFrame:
    """The ``limit`` rows with the largest ``by``; Spark keeps ``limit`` rows per task."""
    return records.orderBy(_quoted(by).desc_nulls_last(), _quoted(tie)).limit(limit)


def union_records(*tables: DataFrame) -> DataFrame:
    """Union by name of ragged tables; a missing field is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_records(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Deep merge on unique keys: the right value wins, struct fields and map entries merge one by one at any depth.

    A null of the right side, column, field or map value, leaves the left value.
    """
    a, b = left.alias("a"), right.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.`{key}`").eqNullSafe(F.col(f"b.`{key}`")) for key in keys])
    types_a = {f.name: f.dataType for f in left.schema}
    types_b = {f.name: f.dataType for f in right.schema}
    columns = []
    for name in [*types_a, *[name for name in types_b if name not in types_a]]:
        if name not in types_b:
            column = F.col(f"a.`{name}`")
        elif name not in types_a:
            column = F.col(f"b.`{name}`")
        else:
            column = _merged(F.col(f"a.`{name}`"), F.col(f"b.`{name}`"), types_a[name], types_b[name])
        columns.append(column.alias(name))
    return a.join(b, on, "full_outer").select(*columns)


def _merged(a: Column, b: Column, type_a: T.DataType, type_b: T.DataType) -> Column:
    if isinstance(type_a, T.MapType) and isinstance(type_b, T.MapType) and type_a.keyType == type_b.keyType:
        if not _mergeable(type_a.valueType, type_b.valueType):
            return F.coalesce(b, a)
        both = F.map_zip_with(a, b, lambda _, x, y: _merged(x, y, type_a.valueType, type_b.valueType))
        return F.coalesce(both, b, a) if type_a.valueType == type_b.valueType else both
    if not (isinstance(type_a, T.StructType) and isinstance(type_b, T.StructType)):
        return F.coalesce(b, a)
    fields_a = {f.name: f.dataType for f in type_a}
    fields_b = {f.name: f.dataType for f in type_b}
    parts = []
    for name in [*fields_a, *[name for name in fields_b if name not in fields_a]]:
        if name not in fields_b:
            part = a[name]
        elif name not in fields_a:
            part = b[name]
        else:
            part = _merged(a[name], b[name], fields_a[name], fields_b[name])
        parts.append(part.alias(name))
    return F.when(a.isNotNull() | b.isNotNull(), F.struct(*parts))


def _mergeable(type_a: T.DataType, type_b: T.DataType) -> bool:
    """Whether map values merge entry by entry: alike, or both structs or maps."""
    nested = (T.StructType, T.MapType)
    return type_a == type_b or (isinstance(type_a, nested) and type(type_a) is type(type_b))


def flatten_records(records: DataFrame, sep: str = "_") -> DataFrame:
    """Struct fields become columns named by their path; lists stay. The later name wins."""

    def leaves(schema: T.StructType, path: str, prefix: str):
        for f in schema:
            at, name = f"{path}`{f.name}`", f"{prefix}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, f"{at}.", f"{name}{sep}")
            else:
                yield name, F.col(at).alias(name)

    return records.select(*dict(leaves(records.schema, "", "")).values())


def _numbered_keys(keys: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """Keys with ``_index``, their 0-based place, and how many there are.

    Range-partition, sort each range, and cut the lineage there: the ranges are
    then files, so counting them and numbering their rows see the same rows even
    if an executor is lost in between. The driver sees one count per range.
    """
    ranges = cut_lineage(keys.repartitionByRange(*order).sortWithinPartitions(*order))
    counts = ranges.groupBy(F.spark_partition_id().alias("at")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {row["at"]: row["n"] for row in counts.collect()}
    starts = [0]
    for at in range(max(sizes, default=0)):
        starts.append(starts[-1] + sizes.get(at, 0))
    # The id holds the range in its upper bits and the place in it in the lower 33.
    ids = ranges.withColumn("_id", F.monotonically_increasing_id())
    start = F.get(F.lit(starts).cast("array<bigint>"), F.shiftright("_id", 33).cast("int"))
    numbered = ids.withColumn("_index", start + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    return numbered, sum(sizes.values())


def _at_or_before(bounds: Column, key: Column, most: int) -> Column:
    """How many of the sorted ``bounds``, at most ``most``, are not after the key: a binary search."""
    steps = [1 << at for at in reversed(range(most.bit_length()))]

    def further(found: Column, step: Column) -> Column:
        bound = F.get(bounds, found + step - 1)
        return F.when(bound["key"] <= key, found + step).otherwise(found)

    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), further)


def _numbered(records: DataFrame, order_by: tuple[str, ...], group: int) -> tuple[DataFrame, int]:
    """Records with ``_index``, and how many there are; groups of ``group`` consecutive rows share a task.

    Only the order columns are sorted and stored, to find exact bounds at multiples of
    ``group``: at most one per shuffle partition, in one array that each task searches. They
    make the bucket of a row a function of its key alone; the rows themselves are shuffled
    once, by bucket, and numbered there.

    The records are read twice, for their keys and as a whole, so they must be the same
    both times; store them first if they come from a clock or a random source.
    """
    keys, total = _numbered_keys(records.select(*[_quoted(name) for name in order_by]), [_quoted(name) for name in order_by])
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = group * max(1, -(-total // (group * parts)))
    most = (total - 1) // per if total else 0
    key = F.struct(*[_quoted(name).alias(f"k{at}") for at, name in enumerate(order_by)])
    if not most:
        nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*[_quoted(name) for name in order_by]))
        return records.withColumn("_index", (nth - 1).cast("bigint")), total
    options = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    told = keys.select(key.alias("key"), F.to_json(key, options).alias("text"), "_index")
    near = told.where(((F.col("_index") + 1) % per <= 1) & (F.col("_index") >= per - 1)).select("text", "_index").collect()  # two rows per bound
    at = {row["_index"]: row["text"] for row in near}
    bounds = {at[index]: index for index in range(total - total % per if total % per else total - per, 0, -per)}
    if any(at[index - 1] == text for text, index in bounds.items()):
        # A bucket begins at the first of the rows that share its bound's key.
        firsts = told.where(F.col("text").isin(list(bounds))).groupBy("text").agg(F.min("_index").alias("first"))
        bounds = {row["text"]: row["first"] for row in firsts.collect()}
    # One constant, so that the plan does not grow with the number of bounds.
    listed = ",".join(f'{{"key":{text},"first":{first}}}' for text, first in sorted(bounds.items(), key=lambda bound: bound[1]))
    kind = T.ArrayType(T.StructType([T.StructField("key", told.schema["key"].dataType), T.StructField("first", T.LongType())]))
    constant = F.from_json(F.lit(f"[{listed}]"), kind, options)
    bucket = _at_or_before(constant, key, len(bounds))
    start = F.coalesce(F.get(constant, F.col("_bucket") - 1)["first"], F.lit(0))
    rows = records.withColumn("_bucket", bucket)
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy(*[_quoted(name) for name in order_by]))
    return rows.withColumn("_index", start + nth - 1).drop("_bucket"), total


def with_row_number(records: DataFrame, *order_by: str, name: str = "_index") -> DataFrame:
    """Global 0-based position in the order of columns that are unique together."""
    return _numbered(records, order_by, 1)[0].withColumnRenamed("_index", name)


def with_chunks(
    records: DataFrame, size: int, *order_by: str, name: str = "_chunk", count: str | None = None
) -> DataFrame:
    """Number groups of ``size`` consecutive rows from 0; ``count`` names a column for how many there are."""
    numbered, total = _numbered(records, order_by, size)
    chunks = numbered.withColumn(name, F.floor(F.col("_index") / size)).drop("_index")
    return chunks.withColumn(count, F.lit(-(-total // size)).cast("bigint")) if count else chunks
