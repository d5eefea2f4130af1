"""All-against-all distances in bounded blocks.

Rows of both sides are dealt into blocks of an expected size by a scattered id, every left
block meets every right block in one grouped map, and only per-row aggregates leave it. Pairs are never
materialised and no block depends on how keys or clusters are distributed. A row is sent once per block of the other side, so
blocks grow with the table up to a bound; a task works through one tile by tile.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismill.functions.keys import scatter

ROWS_PER_BLOCK = 1024  # of a tile, and of a block at least
TILES = 16  # a block has at most on a side
BLOCKS = 12  # a side has before its blocks grow


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances; tiny negatives from cancellation become 0."""
    out = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.maximum(out, 0)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def _block_count(df: DataFrame, rows_per_block: int) -> int:
    n = df.count()
    return max(1, -(-n // max(rows_per_block, min(TILES * rows_per_block, n // BLOCKS))))


def _tiles(rows: pd.DataFrame, size: int) -> list[pd.DataFrame]:
    cuts = np.linspace(0, len(rows), -(-len(rows) // size) + 1).astype(int)
    return [rows.iloc[i:j].reset_index(drop=True) for i, j in zip(cuts, cuts[1:])]


def each_block_pair(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    rows_per_block: int = ROWS_PER_BLOCK,
    *,
    merge: Callable[[pd.DataFrame], pd.DataFrame],
) -> DataFrame:
    """Run ``work(left, right)`` for every pair of tiles; ``merge`` makes what left rows have of several tiles one result of a block."""
    lefts, rights = _block_count(left, rows_per_block), _block_count(right, rows_per_block)
    a = left.withColumn("_lb", scatter(left_id) % lefts).withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(rights - 1))))
    b = right.withColumn("_rb", scatter(right_id) % rights).withColumn("_lb", F.explode(F.sequence(F.lit(0), F.lit(lefts - 1))))
    names = schema.fieldNames() if isinstance(schema, T.StructType) else [p.split()[0] for p in schema.split(",")]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({n: [] for n in names})
        rights, out = _tiles(y, rows_per_block), []
        for own in _tiles(x, rows_per_block):
            found = [work(own, other) for other in rights]
            out.append(found[0] if len(found) == 1 else merge(pd.concat(found, ignore_index=True)))
        return pd.concat(out, ignore_index=True)

    keys = [F.col("_lb").cast("bigint"), F.col("_rb").cast("bigint")]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, schema)
