"""Forests of bagged trees over binned features, a few trees a task.

A tree only sees bins, so rows of equal bins are one cell. How often a bootstrap takes a row is a Poisson number drawn where the row
lies, and what a tree needs of a cell (rows by class, or rows and their sum) is added up there. So a tree's table has a row per cell
however many rows there are, and a task grows its trees from it. Where the cells do not fit in one block, MLlib grows the forest level
by level.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismill.operators import boosting

BINS = 255  # besides one for missing values
TREES_PER_TASK = 5
ALIKE = 3.0  # rows per cell from which it pays to score one row of each
_DRAW_ROWS = 250_000  # rows a task draws for, at most
_SUMS = 1 << 22  # numbers of a histogram that are held at once


def cut_points(df: DataFrame, width: int) -> list[np.ndarray]:
    """Per feature its least value and its quantiles; a value is in the bin of the first that is not below it."""
    shares = [i / BINS for i in range(BINS - 1)]
    values = [F.get("_v", F.lit(j)) for j in range(width)]
    quantiles = [F.percentile_approx(F.when(~F.isnan(v), v), shares, 20_000).alias(f"c{j}") for j, v in enumerate(values)]
    row = df.select(vector_to_array("features").alias("_v")).agg(*quantiles).first()
    return [np.unique(np.array(row[f"c{j}"] or [0.0])) for j in range(width)]


def with_code(df: DataFrame, cuts: list[np.ndarray], name: str = "code") -> DataFrame:
    """Add the bins of ``features``, a byte each."""

    @F.pandas_udf("binary")
    def code(rows: pd.Series) -> pd.Series:
        if rows.empty:
            return pd.Series([], dtype=object)
        return pd.Series([c.tobytes() for c in boosting.coded(np.stack([np.asarray(r, float) for r in rows]), cuts)], index=rows.index)

    return df.withColumn(name, code(vector_to_array("features")))


def grow_tree(codes: np.ndarray, sums: np.ndarray, rows: np.ndarray, depth: int, tried: int, rng: np.random.Generator) -> tuple[tuple, np.ndarray]:
    """A tree's arrays as :func:`boosting.leaf_of` takes them, with ``sums`` and rows of each node, and what each feature gained.

    ``sums`` has rows by class, or the sum of the target; a split gains what it adds to their squares over rows, which is Gini impurity
    or squared error. Every node tries ``tried`` features drawn anew.
    """
    width, bins = codes.shape[1], int(codes.max(initial=0)) + 1
    feature, cut, left = [np.full(1, -1, np.int16)], [np.zeros(1, np.uint8)], [np.zeros(1, np.int32)]
    held = [np.column_stack([sums.sum(axis=0, keepdims=True), rows.sum(keepdims=True)])]
    gained = np.zeros(width)
    use, node, count, made = np.arange(len(codes)), np.zeros(len(codes), np.int64), 1, 1
    for level in range(depth):
        order = np.argsort(node, kind="stable")
        use, node = use[order], node[order]
        drawn = np.argsort(rng.random((count, width)), axis=1)[:, :tried]
        starts = np.searchsorted(node, np.arange(count + 1))
        best = np.zeros(count)
        best_feature, best_cut = np.full(count, -1, np.int16), np.zeros(count, np.uint8)
        together = max(1, _SUMS // (tried * bins * (sums.shape[1] + 1)))
        for low in range(0, count, together):
            high = min(count, low + together)
            own, at = use[starts[low] : starts[high]], node[starts[low] : starts[high]] - low
            shape = (high - low, tried, bins)
            place = ((at[:, None] * tried + np.arange(tried)) * bins + codes[own[:, None], drawn[at + low]]).ravel()
            adds = [np.bincount(place, np.repeat(v[own], tried), math.prod(shape)).reshape(shape).cumsum(axis=2) for v in (*sums.T, rows)]
            n, whole = adds[-1], adds[-1][:, :, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = sum(a * a / n + (a[:, :, -1:] - a) ** 2 / (whole - n) - a[:, :, -1:] ** 2 / whole for a in adds[:-1])
            gain = np.where((n > 0) & (n < whole), gain, 0.0).reshape(high - low, -1)
            top = gain.argmax(axis=1)
            best[low:high] = gain[np.arange(high - low), top]
            best_feature[low:high] = drawn[np.arange(low, high), top // bins]
            best_cut[low:high] = top % bins
        total = held[-1][:, -1]
        split = best > 1e-9 * np.maximum(1.0, total)
        if not split.any():
            break
        np.add.at(gained, best_feature[split], best[split])
        number = np.cumsum(split) - 1
        feature[-1][split], cut[-1][split] = best_feature[split], best_cut[split]
        left[-1][split] = made + 2 * number[split]
        going = split[node]
        use, node = use[going], node[going]
        node = 2 * number[node] + (codes[use, best_feature[node]] > best_cut[node])
        count = 2 * int(split.sum())
        made += count
        feature.append(np.full(count, -1, np.int16))
        cut.append(np.zeros(count, np.uint8))
        left.append(np.zeros(count, np.int32))
        held.append(np.column_stack([np.bincount(node, v[use], count) for v in (*sums.T, rows)]))
    return (np.concatenate(feature), np.concatenate(cut), np.concatenate(left), np.concatenate(held)), gained


def _draw(cells: DataFrame, trees: int, classes: int, seed: int, width: int, center: float) -> DataFrame:
    """Per task, batch of cells and chunk of trees the cells' sums in each tree's bootstrap: ``chunk``, ``codes`` and ``sums``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
            label, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            firsts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]).any(axis=1)]))
            for chunk in range(-(-trees // TREES_PER_TASK)):
                some = min(TREES_PER_TASK, trees - chunk * TREES_PER_TASK)
                taken = rng.poisson(n[:, None], (len(n), some)).astype(float)
                parts = [taken * (label == k)[:, None] for k in range(classes)] if classes else [taken * (label - center)[:, None], taken]
                sums = np.stack([np.add.reduceat(p, firsts, axis=0) for p in parts], axis=2)  # cells x trees x sums
                columns = [pa.array([chunk], pa.int32()), pa.array([codes[firsts].tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "codes", "sums"])

    return cells.mapInArrow(run, "chunk int, codes binary, sums binary")


class Forest(Estimator):
    """``trees`` bagged trees of a set depth over a ``features`` vector and a numeric ``label``; no ``classes``: a regression.

    ``otherwise`` fits tables whose different rows of bins are too many for a task.
    """

    def __init__(self, otherwise: Estimator, classes: int, trees: int, depth: int, seed: int = 0):
        super().__init__()
        self.otherwise, self.classes, self.trees, self.depth, self.seed = otherwise, classes, int(trees), int(depth), seed

    def _fit(self, df: DataFrame) -> Model:
        first = df.select("features").first()
        if first is None:
            return self.otherwise.fit(df)
        width, trees, depth, classes, seed = len(first["features"]), self.trees, self.depth, self.classes, self.seed
        cuts = cut_points(df, width)
        center = 0.0 if classes else float(df.agg(F.avg("label")).first()[0])
        merged = with_code(df, cuts).groupBy("code", "label").agg(F.count("*").alias("n")).persist()
        try:
            facts = merged.agg(F.count_distinct("code").alias("cells"), F.count("*").alias("rows"), F.sum("n").alias("n")).first()
            if facts["cells"] > boosting.BLOCK_ROWS:
                return self.otherwise.fit(df)
            parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-facts["rows"] // _DRAW_ROWS))
            cells = merged.repartition(parts, "code").sortWithinPartitions("code", "label")
            chunks = -(-trees // TREES_PER_TASK)
            tried = math.ceil(math.sqrt(width)) if classes else width
            each = classes or 2

            def grow(table: pa.Table) -> pa.Table:
                chunk = table.column("chunk")[0].as_py()
                some = min(TREES_PER_TASK, trees - chunk * TREES_PER_TASK)
                codes = np.concatenate([np.frombuffer(c.as_buffer(), np.uint8) for c in table.column("codes")]).reshape(-1, width)
                sums = np.concatenate([np.frombuffer(c.as_buffer(), float) for c in table.column("sums")]).reshape(-1, some, each)
                out = []
                for t in range(some):
                    own = sums[:, t]
                    rows = own.sum(axis=1) if classes else own[:, 1]
                    has = rows > 0
                    rng = np.random.default_rng([seed, 1, chunk, t])
                    arrays, gained = grow_tree(codes[has], own[has, : classes or 1], rows[has], depth, tried, rng)
                    out.append(pickle.dumps(_leaves(arrays, classes, center) + (gained,)))
                return pa.table({"tree": pa.array([chunk * TREES_PER_TASK + t for t in range(some)], pa.int32()), "grown": pa.array(out, pa.binary())})

            drawn = _draw(cells, trees, classes, seed, width, center).repartition(chunks, "chunk")
            grown = drawn.groupBy("chunk").applyInArrow(grow, "tree int, grown binary").collect()  # a row per tree
        finally:
            merged.unpersist()
        return ForestModel([pickle.loads(r["grown"]) for r in sorted(grown, key=lambda r: r["tree"])], cuts, classes, facts["n"] / facts["cells"])


def _leaves(arrays: tuple, classes: int, center: float) -> tuple:
    """The arrays with what a node says of its rows: shares of the classes, or the mean."""
    feature, cut, left, held = arrays
    n = np.maximum(held[:, -1:], 1e-300)
    value = held[:, :-1] / n if classes else held[:, :1] / n + center
    return feature, cut, left, value


class ForestModel(Model):
    """Trees as (feature, bin, left child, value) arrays with each feature's gain; the driver holds them. ``alike``: training rows per cell."""

    def __init__(self, trees: list[tuple], cuts: list[np.ndarray], classes: int, alike: float):
        super().__init__()
        self.trees, self.cuts, self.classes, self.alike = trees, cuts, classes, alike

    @property
    def featureImportances(self) -> Vector:
        """Gain of each feature, a share of its tree's, over all trees."""
        total = np.zeros(len(self.cuts))
        for *_, gained in self.trees:
            total += gained / (gained.sum() or 1.0)
        return Vectors.dense(list(total / (total.sum() or 1.0)))

    def _transform(self, df: DataFrame) -> DataFrame:
        """Where rows of equal bins are many, one of each is scored and the result joined back."""
        sent = df.sparkSession.sparkContext.broadcast([t[:4] for t in self.trees])
        cuts, each = self.cuts, self.classes or 1

        def said(codes: np.ndarray) -> np.ndarray:
            total = np.zeros((len(codes), each))
            for tree in sent.value:
                total += tree[3][boosting.leaf_of(tree, codes)]
            return total / len(sent.value)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = said(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, len(cuts)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.list_(pa.float64()))], names=["_of", "_said"])

        @F.pandas_udf("array<double>")
        def each_row(rows: pd.Series) -> pd.Series:
            if rows.empty:
                return pd.Series([], dtype=object)
            return pd.Series(list(said(boosting.coded(np.stack([np.asarray(r, float) for r in rows]), cuts))), index=rows.index)

        if self.alike < ALIKE:
            out = df.withColumn("_said", each_row(vector_to_array("features")))
        else:
            keyed = with_code(df, cuts, "_code")
            parts = 4 * df.sparkSession.sparkContext.defaultParallelism  # few bytes a row, much work: one partition of them would be one task
            known = keyed.select(F.col("_code").alias("_of")).distinct().repartition(parts, "_of").mapInArrow(score, "_of binary, _said array<double>")
            out = keyed.join(known, keyed["_code"] == known["_of"]).drop("_code", "_of")
        if not self.classes:
            return out.withColumn("prediction", F.get("_said", F.lit(0))).drop("_said")
        place = F.array_position("_said", F.array_max("_said")) - 1
        return out.withColumns({"prediction": place.cast("double"), "probability": array_to_vector("_said")}).drop("_said")
