"""Rounding that two engines agree on.

Means of cents often lie exactly half way between two rounded values, where the last bit of the sum
decides. A small fixed shift moves every such tie to the same side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(name: str | Column, digits: int) -> Column:
    column = F.col(name) if isinstance(name, str) else name
    out = F.round(column + F.lit(1.23 * 10.0 ** -(digits + 3)), digits)
    return out.alias(name) if isinstance(name, str) else out


def settled_sql(expression: str, digits: int) -> str:
    return f"round({expression} + 1.23e-{digits + 3}, {digits})"
