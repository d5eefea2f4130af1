"""Repeatable pseudo-random keys that plain SQL can recompute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus and multiplier of the Park-Miller generator.
MODULUS = 2147483647
MULTIPLIER = 48271


def scatter(column: str | Column, seed: int = 0) -> Column:
    """Map integer ids to 0..MODULUS-1 so that neighbouring ids land far apart.

    Two rounds of the multiplicative generator; ids that agree modulo MODULUS collide, so callers
    that need a strict order add the id itself as a second sort key.
    """
    value = F.col(column) if isinstance(column, str) else column
    first = F.pmod(F.pmod(value.cast("bigint") + F.lit(seed + 1), F.lit(MODULUS)) * F.lit(MULTIPLIER), F.lit(MODULUS))
    return F.pmod(F.pmod(first + F.lit(12345), F.lit(MODULUS)) * F.lit(MULTIPLIER), F.lit(MODULUS))


def scatter_sql(column: str, seed: int = 0) -> str:
    """The same key as SQL text, for ids that are not negative."""
    first = f"((({column} + {seed + 1}) % {MODULUS}) * {MULTIPLIER}) % {MODULUS}"
    return f"(((({first}) + 12345) % {MODULUS}) * {MULTIPLIER}) % {MODULUS}"
