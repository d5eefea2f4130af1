"""Boosted trees grown leaf by leaf over binned features, many models at a time.

A tree only sees bins, so rows of equal bins are one row with a weight. A model whose different rows fit in one block grows all its
trees in one task; the models of series, horizons and folds do so side by side, in one job. For larger models a job counts what all of
them need for their next splits: per model, leaf, feature and bin the sums of gradients and the number of rows.
Trees are held by the driver, as every fitted model is: about 0.7 KB a tree.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismill.session import checkpoint_folder

SQUARED, LOGISTIC = "squared", "logistic"
BLOCK_ROWS = 1 << 19  # different rows of bins
_FLAT = 1 << 16  # row bins that are counted at once rather than feature by feature
_CHECKPOINT_EVERY = 25  # trees


@dataclass(frozen=True)
class Settings:
    """Boosting as its users set it: 31 leaves a tree, the best leaf grows first."""

    rounds: int = 300
    rate: float = 0.05
    leaves: int = 31
    bins: int = 255  # besides one for missing values
    min_rows: int = 20
    max_depth: int = 0  # 0: only leaves count
    min_hessian: float = 1e-3
    loss: str = SQUARED
    classes: int = 1  # trees a round: one per class where there are over two


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1. A row goes left when its bin is at most ``bin``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int, gain: float) -> int:
        self.feature[node], self.bin[node], self.gain[node], self.left[node] = feature, cut, gain, len(self.feature)
        for _ in range(2):
            for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.value, 0.0), (self.gain, 0.0), (self.rows, 0)):
                column.append(empty)
        return self.left[node]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature, np.int16), np.array(self.bin, np.int32), np.array(self.left, np.int32), np.array(self.value)


def leaf_of(arrays: tuple[np.ndarray, ...], codes: np.ndarray) -> np.ndarray:
    """Each row's leaf."""
    feature, cut, left, _ = arrays
    node = np.zeros(len(codes), np.int32)
    rows = np.arange(len(codes))
    while len(rows):
        at = node[rows]
        inner = feature[at] >= 0
        rows, at = rows[inner], at[inner]
        node[rows] = left[at] + (codes[rows, feature[at]] > cut[at])
    return node


# --- best splits ----------------------------------------------------------------------


def best_splits(sums: np.ndarray, settings: Settings) -> list[tuple[tuple, tuple | None]]:
    """Per leaf its (gradient, hessian, rows) and its best split, if any: (gain, feature, last bin of the left side).

    ``sums`` has gradients, rows and, unless each row's hessian is 1, hessians by leaf, feature and bin. Equal gains go to the
    first feature, then the lowest bin.
    """
    left = sums.cumsum(axis=3)
    totals = left[:, :, 0, -1]
    g, n, h = left[0, :, :, :-1], left[1, :, :, :-1], left[-1, :, :, :-1]
    all_g, all_n, all_h = totals[0][:, None, None], totals[1][:, None, None], totals[-1][:, None, None]
    fits = (n >= settings.min_rows) & (n <= all_n - settings.min_rows)
    if len(sums) > 2:
        fits &= (h >= settings.min_hessian) & (all_h - h >= settings.min_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g * g / h
        gain += (all_g - g) ** 2 / (all_h - h)
        alone = totals[0] ** 2 / totals[-1]
    gain[~fits] = -np.inf
    gain = gain.reshape(len(gain), -1)
    out = []
    for i, place in enumerate(gain.argmax(axis=1)):
        better = float(gain[i, place] - alone[i])
        feature, cut = divmod(int(place), g.shape[2])
        good = np.isfinite(better) and better > 1e-12 * max(1.0, float(alone[i]))
        out.append(((float(totals[0, i]), float(totals[-1, i]), int(totals[1, i])), (better, feature, cut) if good else None))
    return out


class Growing:
    """One tree while it grows. Leaves wait in order of gain; some are split ahead, since all waiting leaves are counted in one pass."""

    def __init__(self, settings: Settings):
        self.settings, self.tree = settings, Tree()
        self.found: dict[int, tuple | None] = {}
        self.sums: dict[int, tuple] = {}
        self.depth = {0: 0}
        self.asked: list[int] = [0]

    def told(self, node: int, total: tuple, split: tuple | None) -> None:
        self.sums[node] = total
        deep = self.settings.max_depth and self.depth[node] >= self.settings.max_depth
        self.found[node] = None if deep else split

    def chosen(self) -> tuple[list[int], list[tuple[float, int]]]:
        """Nodes that best-first growth splits, and what waits when it needs to know more or has all leaves."""
        waiting = [(-self.found[0][0], 0)] if self.found[0] else []
        taken: list[int] = []
        while waiting and len(taken) + 1 < self.settings.leaves:
            node = waiting[0][1]
            if self.tree.feature[node] < 0:
                return taken, waiting
            heapq.heappop(waiting)
            taken.append(node)
            for child in (self.tree.left[node], self.tree.left[node] + 1):
                if self.found[child]:
                    heapq.heappush(waiting, (-self.found[child][0], child))
        return taken, []

    def ask(self, ahead: int = 1 << 30) -> list[int]:
        """Nodes that the next pass must count; empty when the tree is grown. At most ``ahead`` leaves are split in one pass."""
        taken, waiting = self.chosen()
        room = min(ahead, self.settings.leaves - 1 - len(taken))
        self.asked = []
        for _, node in heapq.nsmallest(room, waiting):
            if self.tree.feature[node] < 0:
                gain, feature, cut = self.found[node]
                left = self.tree.split(node, feature, cut, gain)
                self.depth[left] = self.depth[left + 1] = self.depth[node] + 1
                self.asked += [left, left + 1]
        return self.asked

    def grown(self) -> Tree:
        """The tree without nodes that were split ahead in vain, leaves with their shrunken values."""
        taken = set(self.chosen()[0])
        out, queue = Tree(), [(0, 0)]
        while queue:
            old, new = queue.pop()
            g, h, n = self.sums[old]
            out.rows[new] = n
            if old in taken:
                left = out.split(new, self.tree.feature[old], self.tree.bin[old], self.tree.gain[old])
                queue += [(self.tree.left[old], left), (self.tree.left[old] + 1, left + 1)]
            elif h > 0:
                out.value[new] = -self.settings.rate * g / h
        return out


# --- blocks of rows -------------------------------------------------------------------


@dataclass
class Block:
    """Different rows of bins of some models, held by one task, and their scores so far."""

    unit: np.ndarray  # number of the row's model: key * fold models + fold model
    target: np.ndarray  # the mean, a class's number where there are over two
    weight: np.ndarray  # rows there are of it
    codes: np.ndarray  # rows x features
    score: np.ndarray  # rows x classes


def _gradients(score: np.ndarray, target: np.ndarray, weight: np.ndarray, part: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    if settings.loss == SQUARED:
        return weight * (score[:, 0] - target), weight
    if settings.classes == 1:
        share = 1 / (1 + np.exp(-score[:, 0]))
        return weight * (share - target), weight * share * (1 - share)
    raised = np.exp(score - score.max(axis=1, keepdims=True))
    share = raised[:, part] / raised.sum(axis=1)
    return weight * (share - (target == part)), weight * settings.classes / (settings.classes - 1) * share * (1 - share)


@dataclass(frozen=True)
class Plan:
    """Which rows which model learns from: fold models 0..n-1; model i of a key leaves out what ``learns`` says."""

    folds: int
    rolling: bool

    def learns(self, fold: np.ndarray, model: int) -> np.ndarray:
        """Rolling: folds before the tested one, model + 1; else all but fold ``model``; one fold: all rows."""
        if self.folds == 1 and not self.rolling:
            return np.ones(len(fold), bool)
        return fold < model + 1 if self.rolling else fold != model

    def tested(self, fold: np.ndarray) -> np.ndarray:
        """The model that predicts each row, -1 for none."""
        return fold - 1 if self.rolling else fold


def _histograms(block: Block, asked: dict, trees: dict, plan: Plan, settings: Settings) -> Iterator[tuple[tuple, int, np.ndarray]]:
    """Per model and asked leaf that has rows its sums by feature and bin, as :func:`best_splits` takes them."""
    for unit in np.unique(block.unit):
        own = np.flatnonzero(block.unit == unit)
        codes, score, target, weight = block.codes[own], block.score[own], block.target[own], block.weight[own]
        for part in range(settings.classes):
            name = (*divmod(int(unit), plan.folds), part)
            if not asked.get(name):
                continue
            leaf = leaf_of(trees[name], codes)
            g, h = _gradients(score, target, weight, part, settings)
            for node in asked[name]:
                use = np.flatnonzero(leaf == node)
                if len(use):
                    yield name, node, _sums(codes[use], g[use], weight[use], h[use], settings)


@dataclass
class Boosted:
    """Fitted models: cut points by (key, model), first scores by (key, model, class), trees by round, keys' values in order."""

    settings: Settings
    plan: Plan
    names: list[str]
    keys: list[tuple]
    cuts: dict[tuple[int, int], list[np.ndarray]]
    start: dict[tuple[int, int, int], float]
    trees: list[dict[tuple[int, int, int], Tree]]
    kinds: list[T.StructField]
    rows: "DataFrame | None" = None  # place of the key, fold, target, row and bins by fold model

    def importance(self, key: int = 0, model: int = 0, kind: str = "splits") -> dict[str, float]:
        """Splits on each feature, or the gain they brought."""
        out = dict.fromkeys(self.names, 0.0)
        for grown in self.trees:
            for part in range(self.settings.classes):
                tree = grown[key, model, part]
                for feature, gain in zip(tree.feature, tree.gain):
                    if feature >= 0:
                        out[self.names[feature]] += gain if kind == "gain" else 1.0
        return out

    def scorer(self, model: int = 0):
        """Function from (place of the key, features) to scores by class, for new rows."""
        settings, cuts, start = self.settings, self.cuts, self.start
        flat = {(k, part): [t[k, model, part].arrays() for t in self.trees] for k in range(len(self.keys)) for part in range(settings.classes)}

        def scores(key: int, x: np.ndarray) -> np.ndarray:
            codes = coded(x, cuts[key, model])
            out = np.empty((len(x), settings.classes))
            for part in range(settings.classes):
                out[:, part] = start[key, model, part]
                for tree in flat[key, part]:
                    out[:, part] += tree[3][leaf_of(tree, codes)]
            return out

        return scores


def coded(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of features: one more than the place of the first cut point not below the value; missing values are in bin 0."""
    out = np.empty(x.shape, np.uint8)
    for j, points in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(points, x[:, j], "left") + 1)
    return out


def _cut_points(rows: DataFrame, keys: list[str], features: Column, width: int, plan: Plan, bins: int, own: bool) -> DataFrame:
    """Per key and fold model the quantiles of every feature over the rows the model learns from, and their mean target.

    ``own``: the features of model 0, 1, ... follow each other.
    """
    shares = [i / bins for i in range(1, bins)]
    columns = []
    for model in range(plan.folds):
        learns = F.lit(True) if plan.folds == 1 and not plan.rolling else F.col("fold") < model + 1 if plan.rolling else F.col("fold") != model
        columns.append(F.avg(F.when(learns, F.col("target"))).alias(f"m{model}"))
        for j in range(width):
            value = F.get(features, F.lit(model * width + j if own else j))
            columns.append(F.percentile_approx(F.when(learns & ~F.isnan(value), value), shares, 20_000).alias(f"c{model}_{j}"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *columns)


def fit(
    rows: DataFrame, keys: list[str], names: list[str], target: str = "target", fold: str | None = None, folds: int = 1, rolling: bool = False,
    row_id: str | None = None, settings: Settings = Settings(), views: list[str] | None = None,
) -> Boosted:
    """Boost one model per key and fold.

    ``fold`` is the row's fold: with ``rolling`` (1..folds, 0 only trains) model i learns from the folds before it; else (0..folds - 1)
    from all others. ``views`` names an array column per fold model, if each sees features of its own. Cut points are quantiles of the rows that a model learns from. Targets of a classification are class numbers.
    With a ``row_id``, ``rows`` of the result keeps every row's bins for :func:`out_of_fold`.

    Rows of equal bins (and, with more than two classes, equal targets) are one row with a weight, so what a model learns from is bounded by the
    bins its features have, not by the table. A model of at most ``BLOCK_ROWS`` such rows is grown in one task. For others a pass sends
    the trees to the blocks of rows, which count their waiting leaves; the counts merge by model and leaf, and the best cuts come back.
    Their scores move on once a tree is grown, and are written to the checkpoint folder every so often; a lost executor costs the trees since then.
    """
    context = rows.sparkSession.sparkContext
    checkpoint_folder(rows.sparkSession)
    plan = Plan(folds, rolling)
    width = len(names)
    x = F.flatten(F.array(*views)) if views else F.array(*[F.col(n).cast("double") for n in names])
    number = F.col(row_id).cast("long") if row_id else F.lit(0).cast("long")
    base = rows.select(
        *keys, (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"), F.col(target).cast("double").alias("target"), number.alias("row"),
        F.transform(x, lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x"),
    ).where("target IS NOT NULL")
    facts = _cut_points(base, keys, F.col("x"), width, plan, settings.bins, views is not None).collect()  # one row per key
    facts.sort(key=lambda r: tuple((r[k] is not None, r[k]) for k in keys))
    places = [tuple(r[k] for k in keys) for r in facts]
    cuts, start = {}, {}
    for i, r in enumerate(facts):
        for m in range(folds):
            cuts[i, m] = [np.unique(np.array(r[f"c{m}_{j}"] or [], float)) for j in range(width)]
            for part in range(settings.classes):
                start[i, m, part] = _start(r[f"m{m}"], settings)
    if settings.classes > 1:
        _class_starts(base, keys, places, plan, start, settings)
    binned = _binned(base, keys, places, cuts, plan, width)
    if row_id:
        binned = binned.persist(StorageLevel.MEMORY_AND_DISK)
    merged = _merged(binned, plan, settings, width).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r["unit"]: r["n"] for r in merged.groupBy("unit").agg(F.count("*").alias("n")).collect()}  # one row per model
        large = [unit for unit, n in sizes.items() if n > BLOCK_ROWS]
        every = [(k, m, part) for k in range(len(places)) for m in range(folds) for part in range(settings.classes)]
        trees = [{name: Tree() for name in every} for _ in range(settings.rounds)]  # a model without rows keeps these
        if len(large) < len(sizes):
            small = merged.where(~F.col("unit").isin(large)) if large else merged
            _grow_whole(small, len(sizes) - len(large), start, plan, settings, width, trees)
        if large:
            dealt = merged.where(F.col("unit").isin(large)) if len(large) < len(sizes) else merged
            partitions = -(-sum(sizes[unit] for unit in large) // BLOCK_ROWS)
            _grow_spread(context, _blocks(dealt, start, plan, settings, width, partitions), large, plan, settings, trees)
    finally:
        merged.unpersist()
    return Boosted(settings, plan, names, places, cuts, start, trees, [base.schema[k] for k in keys], binned if row_id else None)


def _grow_spread(context, blocks: RDD, large: list[int], plan: Plan, settings: Settings, trees: list[dict]) -> None:
    """Grow models whose rows fill several blocks. Both children of a leaf are counted rather than one subtracted from a stored
    parent, so a pass depends on nothing but the blocks."""
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    every = [(*divmod(unit, plan.folds), part) for unit in large for part in range(settings.classes)]
    older: list[RDD] = []
    for round_ in range(settings.rounds):
        growing = {model: Growing(settings) for model in every}
        asked = {model: [0] for model in growing}
        while asked:
            sent = {model: growing[model].tree.arrays() for model in asked}
            for (name, node), (total, split) in _pass(context, blocks, asked, sent, plan, settings):
                growing[name].told(node, total, split)
            for model in asked:
                for node in asked[model]:  # no row of any block
                    if node not in growing[model].found:
                        growing[model].told(node, (0.0, 0.0, 0), None)
            asked = {model: nodes for model, g in growing.items() if model in asked and (nodes := g.ask())}
        grown = {model: g.grown() for model, g in growing.items()}
        trees[round_].update(grown)
        arrays = {model: t.arrays() for model, t in grown.items()}
        moved = blocks.map(lambda b, arrays=arrays: _moved(b, arrays, plan, settings)).persist(StorageLevel.MEMORY_AND_DISK)
        if round_ % _CHECKPOINT_EVERY == _CHECKPOINT_EVERY - 1:
            moved.checkpoint()
        older.append(blocks)  # the next pass moves the scores; what it reads may go when the one after begins
        if len(older) > 1:
            older.pop(0).unpersist()
        blocks = moved
    for left in [*older, blocks]:
        left.unpersist()


def _start(mean: float | None, settings: Settings) -> float:
    if mean is None:
        return 0.0
    if settings.loss == SQUARED or settings.classes > 1:
        return float(mean)
    share = min(max(mean, 1e-15), 1 - 1e-15)
    return float(np.log(share / (1 - share)))


def _class_starts(base: DataFrame, keys, places, plan: Plan, start: dict, settings: Settings) -> None:
    """Log shares of the classes among the rows each model learns from."""
    at = {p: i for i, p in enumerate(places)}
    counts = np.zeros((len(places), plan.folds, settings.classes))
    for r in base.groupBy(*keys, "fold", "target").agg(F.count("*").alias("n")).collect():  # keys x folds x classes
        for m in range(plan.folds):
            if plan.learns(np.array([r["fold"]]), m)[0]:
                counts[at[tuple(r[k] for k in keys)], m, int(r["target"])] += r["n"]
    shares = np.log(np.maximum(counts, 1e-15) / np.maximum(counts.sum(axis=2, keepdims=True), 1e-15))
    for i, m, part in np.ndindex(*shares.shape):
        start[i, m, part] = float(shares[i, m, part])


def _binned(base: DataFrame, keys: list[str], places: list[tuple], cuts: dict, plan: Plan, width: int) -> DataFrame:
    """Every row's place of the key, fold, target, number and bins, a byte per fold model and feature."""
    at = {p: i for i, p in enumerate(places)}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            key = np.array([at[p] for p in zip(*(batch.column(k).to_pylist() for k in keys))] if keys else [0] * len(batch), np.int32)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            codes = np.empty((len(batch), plan.folds, width), np.uint8)
            for k in np.unique(key):
                own = np.flatnonzero(key == k)
                for m in range(plan.folds):
                    codes[own, m] = coded(x[own, m * width : (m + 1) * width] if x.shape[1] > width else x[own], cuts[int(k), m])
            size = plan.folds * width
            flat = pa.py_buffer(codes.tobytes())
            bins = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(np.arange(0, len(batch) * size + 1, size, dtype=np.int32).tobytes()), flat])
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("fold"), batch.column("target"), batch.column("row"), bins], names=["key", "fold", "target", "row", "codes"])

    return base.mapInArrow(code, "key int, fold int, target double, row long, codes binary")


def _merged(binned: DataFrame, plan: Plan, settings: Settings, width: int) -> DataFrame:
    """The different rows that each model learns from: number of the model, bins, target and how many there are."""
    learns = lambda m: F.lit(True) if plan.folds == 1 and not plan.rolling else F.col("fold") < m + 1 if plan.rolling else F.col("fold") != m
    models = F.array_compact(F.array(*[F.when(learns(m), F.lit(m)) for m in range(plan.folds)]))
    rows = binned.select("key", "target", "codes", F.explode(models).alias("m"))
    rows = rows.select(
        (F.col("key") * plan.folds + F.col("m")).alias("unit"), F.substr("codes", F.col("m") * width + 1, F.lit(width)).alias("codes"), "target"
    )
    if settings.loss == SQUARED or settings.classes == 1:  # gradients are linear in the target
        return rows.groupBy("unit", "codes").agg(F.avg("target").alias("target"), F.count("*").cast("double").alias("weight"))
    return rows.groupBy("unit", "codes", "target").agg(F.count("*").cast("double").alias("weight"))


def _block(table: pa.Table, start: dict, plan: Plan, settings: Settings, width: int) -> Block:
    """Rows of :func:`_merged` in an order of their own, so that sums do not depend on the shuffle."""
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(table), width)
    unit, target, weight = (table.column(c).to_numpy() for c in ("unit", "target", "weight"))
    order = np.lexsort((target, *codes.T, unit))
    codes, unit, target, weight = codes[order], unit[order], target[order], weight[order]
    score = np.empty((len(codes), settings.classes))
    for u in np.unique(unit):
        score[unit == u] = [start[(*divmod(int(u), plan.folds), part)] for part in range(settings.classes)]
    return Block(unit, target, weight, codes, score)


def _blocks(merged: DataFrame, start: dict, plan: Plan, settings: Settings, width: int, partitions: int) -> RDD:
    """One block per partition; rows of a model lie together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if len(b)]  # a partition of about BLOCK_ROWS rows
        if parts:
            block = _block(pa.Table.from_batches(parts), start, plan, settings, width)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    dealt = merged.repartitionByRange(partitions, "unit", F.xxhash64("codes", "target"))
    return dealt.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))


def _sums(codes: np.ndarray, g: np.ndarray, n: np.ndarray, h: np.ndarray, settings: Settings) -> np.ndarray:
    """Sums of some rows by feature and bin: gradients, rows and, unless each row's hessian is 1, hessians."""
    features, bins = codes.shape[1], settings.bins + 1
    weights = (g, n) if settings.loss == SQUARED else (g, n, h)
    out = np.empty((len(weights), features, bins))
    if codes.size <= _FLAT:
        flat = (np.arange(features) * bins + codes).ravel()
        for i, w in enumerate(weights):
            out[i] = np.bincount(flat, np.repeat(w, features), features * bins).reshape(features, bins)
    else:
        for j in range(features):
            column = codes[:, j].astype(np.intp)
            for i, w in enumerate(weights):
                out[i, j] = np.bincount(column, w, bins)
    return out


def _grown_here(codes: np.ndarray, g: np.ndarray, n: np.ndarray, h: np.ndarray, settings: Settings) -> tuple[Tree, np.ndarray]:
    """A tree over rows that lie in one block, and what it says of each: leaf by leaf; of two new leaves the smaller is counted, the
    other is what is left of their parent."""
    growing = Growing(settings)
    rows, sums, new = {0: np.arange(len(codes))}, {0: _sums(codes, g, n, h, settings)}, [0]
    while new:
        for node, (total, split) in zip(new, best_splits(np.stack([sums[i] for i in new], axis=1), settings)):
            growing.told(node, total, split)
        new = growing.ask(1)
        if new:
            tree = growing.tree
            parent = tree.left.index(new[0])
            own, whole = rows.pop(parent), sums.pop(parent)
            left = codes[own, tree.feature[parent]] <= tree.bin[parent]
            rows[new[0]], rows[new[1]] = own[left], own[~left]
            small, large = sorted(new, key=lambda i: len(rows[i]))
            use = rows[small]
            sums[small] = _sums(codes[use], g[use], n[use], h[use], settings)
            sums[large] = whole - sums[small]
    step = np.zeros(len(codes))
    for node, own in rows.items():
        total_g, total_h, _ = growing.sums[node]
        if total_h > 0:
            step[own] = -settings.rate * total_g / total_h
    return growing.grown(), step


def _grow_whole(merged: DataFrame, units: int, start: dict, plan: Plan, settings: Settings, width: int, trees: list[dict]) -> None:
    """Grow the models that fit in one block, each in a task from its first tree to its last."""

    def grow(table: pa.Table) -> pa.Table:
        block = _block(table, start, plan, settings, width)
        rounds = []
        for _ in range(settings.rounds):
            grads = [_gradients(block.score, block.target, block.weight, part, settings) for part in range(settings.classes)]
            grown = [_grown_here(block.codes, g, block.weight, h, settings) for g, h in grads]
            for part, (_, step) in enumerate(grown):
                block.score[:, part] += step
            rounds.append([tree for tree, _ in grown])
        return pa.table({"unit": pa.array([int(block.unit[0])], pa.int32()), "trees": pa.array([pickle.dumps(rounds)], pa.binary())})

    # few rows, much work: more partitions than models, so that seldom two share a task
    partitions = min(4 * units, 16 * merged.sparkSession.sparkContext.defaultParallelism)
    dealt = merged.repartition(partitions, "unit") if units > 1 else merged.coalesce(1)
    for r in dealt.groupBy("unit").applyInArrow(grow, "unit int, trees binary").collect():  # a row per model
        key, m = divmod(r["unit"], plan.folds)
        for round_, grown in enumerate(pickle.loads(r["trees"])):
            for part, tree in enumerate(grown):
                trees[round_][key, m, part] = tree


def _pass(context, blocks: RDD, asked, trees, plan: Plan, settings: Settings) -> list:
    """((model, node), (total, split)) of all asked leaves that have rows."""
    sent = context.broadcast((asked, trees))

    def count(own: Iterator[Block]) -> Iterator[tuple]:
        wanted, grown = sent.value
        for block in own:
            for name, node, sums in _histograms(block, wanted, grown, plan, settings):
                yield (name, node), sums[:, None]

    merged = blocks.mapPartitions(count).reduceByKey(np.add, max(1, min(len(asked), blocks.getNumPartitions())))
    out = merged.mapValues(lambda v: best_splits(v, settings)[0]).collect()  # a few numbers per model and leaf
    sent.destroy()
    return out


def _moved(block: Block, trees: dict, plan: Plan, settings: Settings) -> Block:
    score = block.score.copy()
    for unit in np.unique(block.unit):
        own = np.flatnonzero(block.unit == unit)
        for part in range(settings.classes):
            tree = trees[(*divmod(int(unit), plan.folds), part)]
            score[own, part] += tree[3][leaf_of(tree, block.codes[own])]
    return Block(block.unit, block.target, block.weight, block.codes, score)


def out_of_fold(fitted: Boosted, spark) -> DataFrame:
    """Keys and row ids with the scores of the model that has not seen them: ``row``, ``fold``, ``target``, ``scores`` by class."""
    plan, settings, width = fitted.plan, fitted.settings, len(fitted.names)
    sent = spark.sparkContext.broadcast([{name: tree.arrays() for name, tree in grown.items()} for grown in fitted.trees])
    start = fitted.start

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fold = batch.column("key").to_numpy(), batch.column("fold").to_numpy()
            model = plan.tested(fold)
            use = np.flatnonzero((model >= 0) & (model < plan.folds))
            if not len(use):
                continue
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(batch), plan.folds, width)
            scores = np.empty((len(batch), settings.classes))
            unit = key * plan.folds + model
            for u in np.unique(unit[use]):
                own = use[unit[use] == u]
                k, m = divmod(int(u), plan.folds)
                mine = codes[own, m]
                for part in range(settings.classes):
                    total = np.full(len(own), start[k, m, part])
                    for grown in sent.value:
                        tree = grown[k, m, part]
                        total += tree[3][leaf_of(tree, mine)]
                    scores[own, part] = total
            kept = batch.take(pa.array(use))
            yield pa.RecordBatch.from_arrays(
                [kept.column("key"), kept.column("row"), kept.column("fold"), kept.column("target"), pa.array(list(scores[use]), pa.list_(pa.float64()))],
                names=["_place", "row", "fold", "target", "scores"],
            )

    out = fitted.rows.mapInArrow(score, "_place int, row long, fold int, target double, scores array<double>")
    if fitted.kinds:
        schema = T.StructType([T.StructField("_place", T.IntegerType()), *fitted.kinds])
        out = out.join(F.broadcast(spark.createDataFrame([(i, *k) for i, k in enumerate(fitted.keys)], schema)), "_place")
    return out.select(*[f.name for f in fitted.kinds], "row", "fold", "target", "scores")
