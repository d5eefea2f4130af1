"""Rules for dataset names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pattern of a dataset name.
NAME_PATTERN = r"^[a-z][a-z0-9_]{0,62}$"


class CatalogError(RuntimeError):
    """A dataset could not be stored, found or queried."""


def check_name(name: str) -> str:
    if not re.match(NAME_PATTERN, name) or name.endswith("\n"):
        raise CatalogError(
            f"bad dataset name {name!r}: start with a-z, then a-z, 0-9 or _, at most 63 characters"
        )
    return name


def valid_name(column: Column) -> Column:
    """Whether each value could name a dataset."""
    return column.rlike(NAME_PATTERN)


def slug(column: Column, prefix: str, fallback: str) -> Column:
    """Prefix a value after lower-casing it and turning every non-alphanumeric into ``_``."""
    safe = F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]", "_")
    safe = F.regexp_replace(safe, r"^_+|_+$", "")
    return F.concat(F.lit(prefix + "_"), F.when(safe == "", fallback).otherwise(safe))


def feed_name(feeds: list[str]) -> str:
    """Several feeds share one dataset."""
    return f"news_{feeds[0]}" if len(feeds) == 1 else "news_mixed"
