"""Names for costly expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(expression: Column, then) -> Column:
    """``then(value)`` with the expression computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(expression), then), 1)
