"""Extraction as a table function for SQL: its columns come from the selector list."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pagegrain.operators import selectors

NAME = "extract_items"


def columns_of(rules: list[dict]) -> T.StructType:
    """One column per field of a selector list: a list for all-of fields, a text for others."""
    fields: dict[str, T.DataType] = {}
    for name, _, _, _, multiple in selectors.compile_rules(rules)["fields"]:
        fields[name] = T.ArrayType(T.StringType()) if multiple else T.StringType()
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


class ExtractItems:
    """``extract_items(html, rules)``: a row per record; ``rules`` is a constant, the selector list as JSON."""

    @staticmethod
    def analyze(html: AnalyzeArgument, rules: AnalyzeArgument) -> AnalyzeResult:
        if not rules.isConstantExpression or not isinstance(rules.value, str):
            raise ValueError("the selector list must be a constant JSON text")
        return AnalyzeResult(schema=columns_of(json.loads(rules.value)))

    def __init__(self):
        self.known: dict[str, tuple[dict, list[str]]] = {}

    def eval(self, html: str, rules: str):
        if rules not in self.known:
            parsed = json.loads(rules)
            self.known[rules] = selectors.compile_rules(parsed), columns_of(parsed).names
        compiled, names = self.known[rules]
        for item in selectors.read_items(html, compiled) if html is not None else []:
            yield tuple(item.get(name) for name in names)


def register(spark: SparkSession, name: str = NAME) -> None:
    """Make the function known to SQL: ``select ... from pages, lateral extract_items(pages.html, '[...]')``."""
    spark.udtf.register(name, F.udtf(ExtractItems, useArrow=True))
