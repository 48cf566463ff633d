"""Text cleaning, safe names and truncation."""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain import fixed_values as fixed
from pagegrain.functions.binding import bind


def strip(text: Column) -> Column:
    """Drop Unicode whitespace at both ends (Spark's plain ``trim`` drops only spaces)."""
    return F.btrim(text, F.lit(fixed.PYTHON_SPACES))


def collapse(text: Column) -> Column:
    """Turn each whitespace run into one space and strip the ends."""
    return F.btrim(F.regexp_replace(text, fixed.SPACE_RUN, " "))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, fixed.TAG_PATTERN, "")


def decode_basic_entities(text: Column) -> Column:
    for entity, char in fixed.TEXT_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def normalise_text(text: Column) -> Column:
    """Typed-pass rule for prose: collapse, decode the basic entities, drop tags."""
    return strip_tags(decode_basic_entities(collapse(text)))


# -- the Arrow part: entity table and NFKC have no Spark built-in -------------------


def _is_text(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_string_view(kind)


#: Strings that are Python objects at once; a whole batch of pages would hold several times its size.
AT_ONCE = 256


def _map_leaves(values: pa.Array, fn) -> pa.Array:
    """Apply ``fn`` to every string at any depth of an Arrow array.

    Struct fields and map keys that begin with ``_`` keep their values. A kind of
    array that may hold strings and isn't known here raises.
    """
    kind = values.type
    if _is_text(kind):
        runs = (values.slice(at, AT_ONCE).to_pylist() for at in range(0, max(len(values), 1), AT_ONCE))
        return pa.concat_arrays([pa.array([None if s is None else fn(s) for s in run], kind) for run in runs])
    if pa.types.is_map(kind):
        rows = values.to_pylist()
        pairs = [pair for row in rows if row is not None for pair in row]
        items = _map_leaves(pa.array([item for _, item in pairs], kind.item_type), fn).to_pylist()
        done = iter((key, old if str(key).startswith("_") else new) for (key, old), new in zip(pairs, items))
        return pa.array([None if row is None else [next(done) for _ in row] for row in rows], kind)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(values), 0))
        starts = pa.concat_arrays([pa.array([0], ends.type), ends])
        leaves = _map_leaves(values.flatten(), fn)
        made = pa.LargeListArray if pa.types.is_large_list(kind) else pa.ListArray
        return made.from_arrays(starts, leaves, type=kind, mask=values.is_null())
    if pa.types.is_struct(kind):
        parts = [
            part if field.name.startswith("_") else _map_leaves(part, fn)
            for field, part in zip(kind, values.flatten())
        ]
        return pa.StructArray.from_arrays(parts, fields=list(kind), mask=values.is_null())
    if pa.types.is_nested(kind) or pa.types.is_dictionary(kind):
        raise TypeError(f"strings inside {kind} cannot be cleaned")
    return values


def _arrow_text(fn, dtype: T.DataType):
    @F.arrow_udf(dtype)
    def mapped(values: pa.Array) -> pa.Array:
        return _map_leaves(values, fn)

    return mapped


def _clean_piece(text: str) -> str:
    return unicodedata.normalize("NFKC", re.sub(fixed.TAG_PATTERN, "", html.unescape(text)))


def clean_string(text: Column) -> Column:
    """Unescape, drop tags, NFKC, collapse whitespace.

    Plain-ASCII strings without ``&`` need neither step that Spark lacks; they
    cross to Python as nulls and are cleaned in the JVM.
    """
    needs_python = text.contains("&") | (F.octet_length(text) != F.length(text))
    cleaned = _arrow_text(_clean_piece, T.StringType())(F.when(needs_python, text))
    return collapse(F.coalesce(cleaned, strip_tags(text)))


def _strip_nested(value: Column, dtype: T.DataType) -> Column:
    """``strip_tags`` for every string inside a nested value but those under ``_`` names."""
    if isinstance(dtype, T.StringType):
        return strip_tags(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: _strip_nested(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(
            value,
            lambda key, item: F.when(key.cast("string").startswith("_"), item).otherwise(
                _strip_nested(item, dtype.valueType)
            ),
        )
    if isinstance(dtype, T.StructType):
        fields = [
            (value[f.name] if f.name.startswith("_") else _strip_nested(value[f.name], f.dataType)).alias(f.name)
            for f in dtype
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def clean_nested(value: Column, dtype: T.DataType) -> Column:
    """``clean_string`` but for whitespace, for every string inside a nested value.

    Values under names that begin with ``_`` stay as they are. Plain ASCII without
    ``&`` stays in the JVM. Whitespace is left to the caller, who walks the nested
    type anyway.
    """
    shown = F.to_json(value)
    needs_python = shown.contains("&") | (F.octet_length(shown) != F.length(shown))
    cleaned = _arrow_text(_clean_piece, dtype)(F.when(needs_python, value))
    return F.coalesce(cleaned, _strip_nested(value, dtype))


def clean_html(text: Column) -> Column:
    """Drop tags first, then unescape: escaped tags survive as text."""
    bare = strip_tags(text)
    decoded = _arrow_text(html.unescape, T.StringType())(F.when(bare.contains("&"), bare))
    return collapse(F.coalesce(decoded, bare))


# -- names -------------------------------------------------------------------------


def safe_id(text: Column) -> Column:
    """Every character that is not a letter or digit becomes ``_``."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")


def safe_file_name(text: Column) -> Column:
    name = F.btrim(F.regexp_replace(text, fixed.UNSAFE_FILE_CHARS, "_"), F.lit(". "))
    # The extension starts at the last dot that has something other than dots before it.
    extension = F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)\z", 1)
    stem = F.left(name, F.length(name) - F.length(extension))
    short = F.concat(F.left(stem, F.lit(fixed.KEPT_FILE_STEM)), extension)
    name = F.when(F.length(name) > fixed.MAX_FILE_NAME, short).otherwise(name)
    return F.when(name == "", F.lit(fixed.DEFAULT_FILE_NAME)).otherwise(name)


def truncate(text: Column, length: int = 100, suffix: str = "...") -> Column:
    """Cut to ``length`` characters, the suffix included."""
    kept = length - len(suffix)
    # A negative bound counts from the end, as a Python slice does.
    head = F.left(text, F.lit(kept)) if kept >= 0 else F.left(text, F.greatest(F.length(text) + kept, F.lit(0)))
    return F.when(F.length(text) > length, F.concat(head, F.lit(suffix))).otherwise(text)


def title_case(text: Column) -> Column:
    """Capitalise words; small words stay low and short acronyms stay up inside the title."""
    def capital(word: Column) -> Column:
        return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substr(word, F.lit(2))))

    def cased(word: Column, at: Column, last: Column) -> Column:
        upper = (word == F.upper(word)) & (word != F.lower(word))
        small = F.lower(word).isin(fixed.SMALL_WORDS) & ~upper
        acronym = upper & (F.length(word) <= fixed.MAX_ACRONYM)
        return (
            F.when((at == 0) | (at == last), capital(word))
            .when(small, F.lower(word))
            .when(acronym, word)
            .otherwise(capital(word))
        )

    # The split is bound once; inside ``transform`` it would run again for every word.
    parts = F.struct(F.split(collapse(text), " ").alias("words"))
    sized = bind(parts, lambda p: F.struct(p["words"].alias("words"), (F.size(p["words"]) - 1).alias("last")))
    return bind(sized, lambda p: F.array_join(F.transform(p["words"], lambda word, at: cased(word, at, p["last"])), " "))
