"""Extraction: pages and selector rules to record rows.

Each page is read once, inside one Arrow function; there is no shuffle. The
function sees the markup column only, so the scan reads just the columns used.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain.functions import urls
from pagegrain.operators import selectors as rules_of
from pagegrain.storage import broadcast_if_small, cut_lineage

ITEM = "_item"


def record_type(rules: list[dict]) -> T.StructType:
    """Columns of the records a selector list yields, in list order."""
    compiled = rules_of.compile_rules(rules)
    kinds: dict[str, bool] = {}
    for name, _, _, _, multiple in compiled["fields"]:
        if kinds.setdefault(name, multiple) != multiple:
            raise ValueError(f"field {name!r} is both one-of and all-of")
    return T.StructType(
        [
            T.StructField(name, T.ArrayType(T.StringType()) if many else T.StringType())
            for name, many in kinds.items()
        ]
    )


def page_items(markup: Column, rules: list[dict]) -> Column:
    """``array<record>`` of a page for one selector list; bad selectors raise here."""
    compiled = rules_of.compile_rules(rules)
    items = T.ArrayType(record_type(rules))

    @F.arrow_udf(items)
    def read(pages: pa.Array) -> pa.Array:
        found = [rules_of.read_items(page.as_py(), compiled) if page.is_valid else [] for page in pages]
        return pa.array(found, arrow_items)

    arrow_items = pa.list_(
        pa.struct(
            [
                (field.name, pa.list_(pa.string()) if isinstance(field.dataType, T.ArrayType) else pa.string())
                for field in record_type(rules)
            ]
        )
    )
    return read(markup)


def extract_records(
    pages: DataFrame, config: dict, keep: tuple[str, ...] = ("url",), html: str = "html"
) -> DataFrame:
    """Records of every page under one selector config.

    With a container rule there is one record per container element, otherwise
    at most one per page; a page without any match yields no row. ``_item`` is
    the place of the record on its page.
    """
    rules = config.get("selectors") or []
    schema = record_type(rules) if rules else T.StructType([])
    if not schema.fields:
        return pages.select(*keep, F.lit(0).alias(ITEM)).where(F.lit(False))
    clash = {name.lower() for name in schema.names} & {name.lower() for name in (*keep, ITEM)}
    if clash:
        raise ValueError(f"selector names clash with kept columns: {sorted(clash)}")
    return (
        pages.select(*keep, F.posexplode(page_items(F.col(html), rules)).alias(ITEM, "_record"))
        .select(*keep, ITEM, "_record.*")
    )


def page_items_by_row(markup: Column, rules: Column) -> Column:
    """``array<map<field, values>>`` of a page under the selector list of its own row.

    ``rules`` is the list as JSON text. A selector outside the grammar matches
    nothing; a bad container yields no item.
    """

    @F.arrow_udf("array<map<string,array<string>>>")
    def read(pages: pa.Array, lists: pa.Array) -> pa.Array:
        compiled = {text: rules_of.compile_known(text) for text in lists.unique().to_pylist()}
        found = []
        for page, text in zip(pages, lists.to_pylist()):
            known = compiled[text]
            items = rules_of.read_items(page.as_py(), known) if known and page.is_valid else []
            found.append(
                [
                    [(name, [value] if isinstance(value, str) else value) for name, value in item.items()]
                    for item in items
                ]
            )
        return pa.array(found, pa.list_(pa.map_(pa.string(), pa.list_(pa.string()))))

    return read(markup, rules)


def unusable_rules(catalogue: DataFrame) -> DataFrame:
    """``task_id, name, selector, is_container``: catalogue rules that extraction cannot use.

    A field rule listed here yields nothing, a container rule voids its task's records.
    """

    @F.arrow_udf("array<struct<name:string,selector:string,is_container:boolean>>")
    def listed(lists: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("name", pa.string()), ("selector", pa.string()), ("is_container", pa.bool_())]))
        return pa.array([rules_of.unusable(text) for text in lists.to_pylist()], kind)

    return catalogue.select("task_id", F.inline(listed(F.to_json("selectors"))))


def extract_by_task(visits: DataFrame, pages: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Records of visited pages, each under the selectors of its task.

    ``visits(task_id, page_id, ...)``, ``pages(page_id, html)``, ``catalogue(task_id,
    selectors)``. One row per record: the visit's columns, ``_item`` and ``record``, a
    map of values (see ``record_columns``).

    A page is read once per distinct selector list, however many tasks visit it, and
    its markup stays in place while those pairs are few enough to broadcast. What
    comes back is joined as records. Every join has one side that is unique in the
    key, so hot keys of the other side can be split.
    """
    rules = catalogue.select("task_id", F.to_json("selectors").alias("_rules"))
    ruled = cut_lineage(visits.join(rules, "task_id"))
    wanted = broadcast_if_small(ruled.select("page_id", "_rules").distinct())
    work = pages.select("page_id", "html").join(wanted, "page_id")
    items = work.select("page_id", "_rules", page_items_by_row(F.col("html"), F.col("_rules")).alias("_items"))
    return ruled.join(items, ["page_id", "_rules"]).select(
        *visits.columns, F.posexplode("_items").alias(ITEM, "record")
    )


def record_columns(records: DataFrame, fields: dict[str, bool]) -> DataFrame:
    """Spread ``record`` maps over typed columns; ``fields`` says which are all-of."""
    others = [name for name in records.columns if name != "record"]
    values = [
        (F.col("record")[name] if many else F.get(F.col("record")[name], F.lit(0))).alias(name)
        for name, many in fields.items()
    ]
    return records.select(*others, *values)


# -- next page ------------------------------------------------------------------


def pagination_rule(pagination: dict) -> list[dict]:
    """Selector list that reads the attribute a pagination kind needs."""
    kind = pagination.get("type") or "link"
    return [
        {
            "name": "raw",
            "selector": pagination.get("selector") or "",
            "type": "attribute",
            "attribute": "onclick" if kind == "button" else "href",
        }
    ]


def next_page_url(html: Column, url: Column, pagination: dict) -> Column:
    """Address of the next page under one pagination config, null where there is none."""
    if not pagination or not pagination.get("selector"):
        return F.lit(None).cast("string")
    raw = F.get(page_items(html, pagination_rule(pagination)), F.lit(0))["raw"]
    name = F.lit(pagination.get("parameter") or "page")
    return urls.next_page(pagination.get("type") or "link", url, raw, name)


def raw_rule(selector: Column, kind: Column) -> Column:
    """``pagination_rule`` for columns, as JSON text."""
    rule = F.array(
        F.struct(
            F.lit("raw").alias("name"),
            selector.alias("selector"),
            F.lit("attribute").alias("type"),
            F.when(kind == "button", F.lit("onclick")).otherwise(F.lit("href")).alias("attribute"),
        )
    )
    return F.to_json(rule)
