"""Text form of typed values, as Python's ``str`` gives it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_text(value: Column, dtype: T.DataType, nested: bool = False) -> Column:
    """Text form of a non-string value as Python prints it: ``True``, ``['a', 'b']``."""
    if isinstance(dtype, T.StringType):
        if not nested:
            return value
        escaped = F.replace(value, F.lit("\\"), F.lit("\\\\"))
        for char, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            escaped = F.replace(escaped, F.lit(char), F.lit(code))
        doubled = escaped.contains("'") & ~escaped.contains('"')
        single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        shown = F.when(doubled, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single)
    elif isinstance(dtype, T.BooleanType):
        shown = F.initcap(value.cast("string"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        # Python keeps plain digits longer than Spark, which writes 1.0E7.
        size = F.abs(value)
        plain = size.between(1e7, 1e16) | size.between(1e-4, 1e-3)
        digits = F.call_function("format_number", value.cast("double"), F.lit("0.0################"))
        shown = F.when(plain & (size < 1e16), digits).otherwise(value.cast("string"))
    elif isinstance(dtype, T.ArrayType):
        parts = F.transform(value, lambda item: as_text(item, dtype.elementType, True))
        shown = F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))
    elif isinstance(dtype, T.StructType):
        parts = [
            F.concat(F.lit(f"'{f.name}': "), as_text(value[f.name], f.dataType, True)) for f in dtype
        ]
        shown = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    else:
        shown = value.cast("string")
    return F.when(value.isNull(), F.lit("None")).otherwise(shown) if nested else F.when(value.isNotNull(), shown)
