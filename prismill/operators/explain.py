"""What a fitted model relies on: permutation importance, own importances, per-row contributions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismill.functions.keys import MODULUS, scatter
from prismill.operators import boosting, forests, models
from prismill.operators.forecasting import regression_scores
from prismill.operators.ordering import _range_count
from prismill.operators.preprocess import onehot_columns
from prismill.operators.profile import sample_rows
from prismill.session import stored_round

SENT = 1 << 18  # different rows of bins whose lines are sent to all rows, rather than rows to them
KNOWN = 1 << 22  # different rows of bins whose class a worker remembers
_TABLED = 7  # path features of which all sets are worked out ahead


def shifted_donors(df: DataFrame, row_id: str, columns: list[str], shifts: int, seed: int = 0, given: list[str] | None = None) -> DataFrame:
    """Add ``donors``: for each row the ``columns`` (or those ``given``) of the rows 1, 2, ... ``shifts`` places later in a shuffled circle of all rows.

    Rows of one id follow each other in the order of their columns.
    The circle is cut into ranges of the shuffled key, whose bounds are arithmetic. One window per range shifts within it; what
    it lacks at its end are the first rows of the ranges that follow, a few rows a range.
    """
    ranges = _range_count(df)
    place = F.floor(F.col("_scatter") * F.lit(ranges) / F.lit(MODULUS)).cast("int")
    spread = df.withColumn("_scatter", scatter(row_id, seed)).withColumn("_range", place)
    order = Window.partitionBy("_range").orderBy("_scatter", row_id, *columns, *[c for c in df.columns if c not in (row_id, *columns)])
    own = F.struct(*(given or columns))
    ordered = spread.withColumns({
        "_own": own, "_n": F.row_number().over(order),
        "_next": F.collect_list(own).over(order.rowsBetween(1, shifts)),
    })
    heads = ordered.where(F.col("_n") <= shifts).groupBy("_range").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_own"))), lambda h: h["_own"]).alias("_heads"))
    # a row per range and turn of the circle: the last range is followed by the first, even if all hold few rows
    turns = heads.select("_range", "_heads", F.explode(F.sequence(F.lit(0), F.lit(shifts))).alias("_turn"))
    later = Window.partitionBy(F.lit(0)).orderBy("_turn", "_range").rowsBetween(1, shifts)
    follow = turns.withColumn("_follow", F.flatten(F.collect_list("_heads").over(later))).where("_turn = 0").select(F.col("_range").alias("_of"), "_follow")
    joined = ordered.join(follow, ordered["_range"] == follow["_of"])
    donors = F.slice(F.concat("_next", "_follow"), 1, shifts)
    return joined.withColumn("donors", donors).drop("_scatter", "_range", "_own", "_n", "_next", "_of", "_follow")


def permutation_importance(
    model: models.TabularModel, df: DataFrame, columns: list[str], row_id: str, repeats: int = 5, seed: int = 0
) -> DataFrame:
    """Score lost when a column's values change places, mean and population deviation over repeats.

    In repeat r every row takes the column from the row r places later in a shuffled circle. ``model`` adds ``prediction`` and
    ``label`` to rows and names its ``task`` and ``target``. All columns and repeats are scored in one pass of the model and
    one aggregate; rows whose value stays the same are scored once with the unchanged table.
    """
    target = model.target
    base = df.select(row_id, target, *columns)
    places = _code_places(model, columns)
    if places:
        return _drops(_forest_scores(model, base, places, row_id, repeats, seed))
    given = shifted_donors(base, row_id, columns, repeats, seed)
    variants = F.array(F.struct(F.lit(None).cast("string").alias("shuffled"), F.lit(-1).alias("repeat")), *[
        F.struct(F.lit(c).alias("shuffled"), F.lit(r).alias("repeat")) for c in columns for r in range(repeats)
    ])
    donor = F.get("donors", F.col("_v.repeat"))
    long = given.withColumn("_v", F.explode(variants))
    changed = F.lit(False)
    for c in columns:
        changed = changed | ((F.col("_v.shuffled") == c) & ~donor[c].eqNullSafe(F.col(c)))
    mixed = long.where(F.col("_v.shuffled").isNull() | changed).select(
        row_id, target, "_v.shuffled", "_v.repeat", F.col("donors"),
        *[F.when(F.col("_v.shuffled") == c, donor[c]).otherwise(F.col(c)).alias(c) for c in columns],
        F.struct(*columns).alias("_old"),
    )
    # an unchanged row counts for all variants that leave it as it is
    same_rows = [
        F.struct(F.lit(c).alias("shuffled"), F.lit(r).alias("repeat")) for c in columns for r in range(repeats)
    ]
    kept = F.filter(F.array(*same_rows), lambda v: _unchanged(v, columns))
    scored = model.transform(mixed).withColumn("_v", F.explode(F.when(
        F.col("shuffled").isNull(), F.concat(F.array(F.struct("shuffled", "repeat")), kept)
    ).otherwise(F.array(F.struct("shuffled", "repeat")))))
    if model.task == models.CLASSIFICATION:
        value = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    else:
        value = regression_scores(F.col("label"), F.col("prediction"))[0]
    return _drops(scored.groupBy("_v.shuffled", "_v.repeat").agg(value.alias("score")))


def _drops(scores: DataFrame) -> DataFrame:
    """Per feature the mean and deviation of what its repeats lose, from scores by ``shuffled`` (null: nothing) and ``repeat``."""
    whole = F.max(F.when(F.col("shuffled").isNull(), F.col("score"))).over(Window.partitionBy(F.lit(0)))
    return (
        scores.withColumn("_drop", whole - F.col("score")).where("shuffled IS NOT NULL")
        .groupBy(F.col("shuffled").alias("feature"))
        .agg(F.avg("_drop").alias("drop"), F.stddev_pop("_drop").alias("spread"))
        .orderBy(F.desc("drop"), "feature")
    )


class KnownClasses:
    """The class a forest gives to rows of bins, each a number, worked out on first use, once for all rows a worker gets."""

    def __init__(self, model: forests.ForestModel):
        self.trees = [t[:4] for t in model.trees]
        self.sizes = np.array([len(c) + 2 for c in model.cuts], np.int64)  # bins of a feature, one for missing values and one behind the last cut
        self.steps = np.concatenate([[1], np.cumprod(self.sizes)[:-1]]).astype(np.int64)
        self.numbers, self.classes = np.zeros(0, np.int64), np.zeros(0, np.int16)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        asked, back = np.unique(numbers, return_inverse=True)
        at = np.searchsorted(self.numbers, asked)
        there = at < len(self.numbers)
        there[there] = self.numbers[at[there]] == asked[there]
        new = asked[~there]
        found = np.empty(len(asked), np.int16)
        found[there] = self.classes[at[there]]
        if len(new):
            codes = (new[:, None] // self.steps % self.sizes).astype(np.uint8)
            total = 0.0
            for tree in self.trees:
                total = total + tree[3][boosting.leaf_of(tree, codes)]
            found[~there] = (total / len(self.trees)).argmax(axis=1)
            if len(self.numbers) + len(new) > KNOWN:
                self.numbers, self.classes = new[:0], found[:0]
            numbers = np.concatenate([self.numbers, new])
            order = np.argsort(numbers, kind="stable")
            self.numbers, self.classes = numbers[order], np.concatenate([self.classes, found[~there]])[order]
        return found[back]


def _code_places(model, columns: list[str]) -> dict[str, list[int]] | None:
    """Places of each column's features in the bins of a forest that classifies; None where the bins do not tell what it says of a changed row."""
    forest = getattr(model, "model", None)
    if not isinstance(forest, forests.ForestModel) or not forest.classes or model.prep.ordinal or model.prep.config.numeric_impute == "drop_rows":
        return None
    if math.prod(len(c) + 2 for c in forest.cuts) >= 1 << 62 or set(columns) - {*model.prep.numeric, *model.prep.categorical}:
        return None
    owners = [n for n in model.prep.numeric] + [n for n in model.prep.categorical for _ in onehot_columns(n, *model.prep.onehot[n])]
    return {c: [i for i, n in enumerate(owners) if n == c] for c in columns}


def _forest_scores(model: models.TabularModel, base: DataFrame, places: dict[str, list[int]], row_id: str, repeats: int, seed: int) -> DataFrame:
    """Accuracy by ``shuffled`` column and ``repeat``: a row gets its donors' bins, and counts where it lies for all variants.

    So neither variants nor their scores are rows that are moved.
    """
    columns, width = list(places), len(model.model.cuts)
    kept = base.withColumn("_raw", F.struct(*columns))
    coded = forests.with_code(model.prep.transform(kept), model.model.cuts, "_code").select(row_id, model.target, "_raw.*", "_code")
    given = models.with_label(shifted_donors(coded, row_id, columns, repeats, seed, ["_code"]), model.target, model.labels)
    sent = base.sparkSession.sparkContext.broadcast(KnownClasses(model.model))
    variants = [(None, -1), *((c, r) for c in columns for r in range(repeats))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, width)
            donors = [np.frombuffer(b"".join(batch.column(2 + r).to_pylist()), np.uint8).reshape(-1, width) for r in range(repeats)]
            number = own @ known.steps
            moved = [(d[:, places[c]].astype(np.int64) - own[:, places[c]]) @ known.steps[places[c]] for c in columns for d in donors]
            classes = known.of(np.concatenate([number, *(number + m for m in moved)])).reshape(len(variants), -1)
            right = ((classes == label) & ~np.isnan(label)).sum(axis=1)
            n = np.full(len(variants), (~np.isnan(label)).sum())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(variants)), pa.int32()), pa.array(n), pa.array(right)], names=["v", "n", "right"])

    rows = given.select("label", "_code", *[F.get("donors", F.lit(r))["_code"].alias(f"_d{r}") for r in range(repeats)])
    counts = rows.mapInArrow(count, "v int, n long, right long").groupBy("v").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    named = F.array(*[F.struct(F.lit(c).cast("string").alias("shuffled"), F.lit(r).alias("repeat")) for c, r in variants])
    return counts.select(F.get(named, F.col("v")).alias("v"), (F.col("right") / F.nullif("n", F.lit(0))).alias("score")).select("v.*", "score")


def _unchanged(variant: Column, columns: list[str]) -> Column:
    donor = F.get("donors", variant["repeat"])
    out = F.lit(False)
    for c in columns:
        out = out | ((variant["shuffled"] == c) & donor[c].eqNullSafe(F.col("_old")[c]))
    return out


def unused_features(importance: DataFrame) -> DataFrame:
    return importance.where(F.col("drop") <= 0).select("feature", "drop")


def model_importance(model: models.TabularModel, spark) -> DataFrame | None:
    """The model's own importances over the expanded features; mean absolute coefficient for linear models."""
    inner = model.model
    if hasattr(inner, "featureImportances"):
        values = inner.featureImportances.toArray()
    elif hasattr(inner, "coefficientMatrix"):
        values = np.abs(inner.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(inner, "coefficients"):
        values = np.abs(inner.coefficients.toArray())
    else:
        return None
    rows = list(zip(model.prep.columns(), [float(v) for v in values]))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def contributions(
    model: models.TabularModel, df: DataFrame, row_id: str, max_samples: int | None = None, permutations: int = 20,
    background: int = 100, class_index: int = 1, seed: int = 0,
) -> DataFrame:
    """Sampled Shapley values (Strumbelj & Kononenko 2014) of all rows, or of a sample of ``max_samples``.

    A walk starts at a background row and takes over the explained row's features one by one in random order;
    a feature's share is the change it causes, averaged over walks. Shares of a walk add up to the
    difference of its two ends, so per row they sum to prediction minus base value.
    Output: row, feature, value, contribution, base and prediction.
    """
    names = model.prep.columns()
    width = len(names)
    ready = model.prep.transform(df)
    arrays = ready.select(F.col(row_id).cast("bigint").alias("row"), vector_to_array("features").alias("x"))
    sample = arrays if max_samples is None else sample_rows(arrays, max_samples, "row", seed)
    # at most ``background`` rows, numbered by their place in a sorted array
    pool = sample_rows(arrays, background, "row", seed + 1).agg(F.collect_list("x").alias("pool"))
    walks = sample.withColumn("_pool", pool.scalar()).withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    key = F.col("row") * permutations + F.col("walk")
    pick = (scatter(key, seed + 2) % F.size("_pool")).cast("int")
    shuffled = F.sort_array(F.array(*[F.struct(scatter(key, seed + 3 + 7919 * j).alias("r"), F.lit(j).alias("j")) for j in range(width)]))
    placed = walks.select("row", "walk", "x", F.get("_pool", pick).alias("z"), F.transform(shuffled, lambda s: s["j"]).alias("turn"))
    steps = placed.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(width))))
    taken = F.slice("turn", F.lit(1), F.col("step"))
    mixed = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda j: F.when(F.array_contains(taken, j), F.get("x", j)).otherwise(F.get("z", j)),
    )
    points = steps.select("row", "walk", "step", "turn", "x", array_to_vector(mixed).alias("features"))
    scored = model.model.transform(points).withColumn("_f", _output(model, class_index))
    before = F.lag("_f").over(Window.partitionBy("row", "walk").orderBy("step"))
    changes = scored.withColumn("_c", F.col("_f") - before)
    moved = changes.where("step > 0").select(
        "row", F.get("turn", F.col("step") - 1).alias("j"), "_c", "x"
    )
    named = F.array(*[F.lit(n) for n in names])
    shares = moved.groupBy("row", "j").agg(F.avg("_c").alias("contribution"), F.first("x").alias("x"))
    ends = scored.groupBy("row").agg(
        F.avg(F.when(F.col("step") == 0, F.col("_f"))).alias("base"), F.avg(F.when(F.col("step") == width, F.col("_f"))).alias("prediction")
    )
    return shares.join(ends, "row").select(
        F.col("row").alias(row_id), F.get(named, F.col("j")).alias("feature"), F.get("x", F.col("j")).alias("value"), "contribution", "base", "prediction"
    )


# --- exact contributions to boosted trees ---------------------------------------------


def leaf_boxes(tree: boosting.Tree) -> list[tuple[float, dict[int, tuple[int, int]]]]:
    """Per leaf its value and, by feature of its path, the bins (above, up to) that lead to it."""
    out, queue = [], [(0, {})]
    while queue:
        node, box = queue.pop()
        feature = tree.feature[node]
        if feature < 0:
            out.append((tree.value[node], box))
            continue
        low, high = box.get(feature, (-1, 1 << 30))
        queue += [
            (tree.left[node], {**box, feature: (low, min(high, tree.bin[node]))}),
            (tree.left[node] + 1, {**box, feature: (max(low, tree.bin[node]), high)}),
        ]
    return out


def _shares(up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a feature earns that only the row meets, of ``up`` such and ``down`` that only the other row meets; and what one of those costs."""
    facts = np.array([math.factorial(i) for i in range(64)], float)
    whole = facts[up + down]
    return np.where(up > 0, facts[np.maximum(up - 1, 0)] * facts[down] / whole, 0.0), np.where(down > 0, facts[up] * facts[np.maximum(down - 1, 0)] / whole, 0.0)


def _set_shares(sets: np.ndarray, others: np.ndarray, weight: np.ndarray, features: int) -> np.ndarray:
    """What each path feature earns of a leaf of value 1, for rows that meet the features of ``sets`` (numbers of bits) against ``others``."""
    bits = 1 << np.arange(features)
    lacks, others_lack = (sets[:, None] & bits) == 0, (others[:, None] & bits) == 0
    # a leaf is reached if a mixture can meet all: what the other lacks only the row has, what the row lacks only the other
    reached = (sets[:, None] | others) == (1 << features) - 1
    gain, loss = _shares(np.where(reached, others_lack.sum(axis=1), 0), np.where(reached, lacks.sum(axis=1)[:, None], 0))
    used = np.where(reached, weight, 0.0)
    return (used * gain) @ others_lack - lacks * (used * loss).sum(axis=1)[:, None]


class LeafTables:
    """Per leaf the shares of its path features by the set of them that a row meets, worked out on first use, once for all rows a worker gets."""

    def __init__(self, others: np.ndarray, boxes: list[list[tuple[float, dict[int, tuple[int, int]]]]]):
        self.others, self.boxes = others, boxes

    @cached_property
    def leaves(self) -> list[tuple]:
        out, others, place = [], self.others, np.arange(1 << 8)
        for value, box in (leaf for leaves in self.boxes for leaf in leaves):
            if not box or value == 0:
                continue
            # per feature what a bin adds to the number of the set
            met = [np.where((place > low) & (place <= high), 1 << i, 0) for i, (low, high) in enumerate(box.values())]
            found = sum(m[others[:, f]] for f, m in zip(box, met))
            rest, times = np.unique(found, return_counts=True)
            weight = value * times / len(others)
            table = _set_shares(np.arange(1 << len(box)), rest, weight, len(box)).T.copy() if len(box) <= _TABLED else None
            out.append((list(box), met, rest, weight, table))
        return out

    def explain(self, codes: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((width, len(codes)))
        columns = codes.T.astype(np.intp)
        for features, met, rest, weight, table in self.leaves:
            own = sum(m.take(columns[f]) for f, m in zip(features, met))
            if table is None:
                sets, own = np.unique(own, return_inverse=True)
                table = _set_shares(sets, rest, weight, len(features)).T
            for f, shares in zip(features, table):
                out[f] += shares.take(own)
        return out.T


def explain_codes(codes: np.ndarray, others: np.ndarray, boxes: list[list[tuple[float, dict[int, tuple[int, int]]]]], width: int) -> np.ndarray:
    """Shapley values of the trees' sum for rows of bins, against the mean of the ``others``.

    A leaf counts for a mixture of two rows if each feature of its path is met by the row it is taken from. So per leaf a row is the
    set of path features it meets; each set is worked out once against all others.
    """
    return LeafTables(others, boxes).explain(codes, width)


def _explained(
    model: models.TabularModel, df: DataFrame, row_id: str, background: int, class_index: int, seed: int
) -> tuple[DataFrame, DataFrame, float]:
    """All rows (``row``, ``x``, ``code``: their bins), the ``shares`` and ``prediction`` of each different ``code``, and the base value."""
    fitted, names = model.model.fitted, model.prep.columns()
    part = class_index if fitted.settings.classes > 1 else 0
    cuts = fitted.cuts[0, 0]
    boxes = [leaf_boxes(grown[0, 0, part]) for grown in fitted.trees]
    start = fitted.start[0, 0, part]

    @F.pandas_udf("binary")
    def code(rows: pd.Series) -> pd.Series:
        if rows.empty:
            return pd.Series([], dtype=object)
        return pd.Series([c.tobytes() for c in boosting.coded(np.stack([np.asarray(r, float) for r in rows]), cuts)], index=rows.index)

    ready = model.prep.transform(df)
    coded = ready.select(F.col(row_id).alias("row"), vector_to_array("features").alias("x")).withColumn("code", code("x"))
    pool = [r["code"] for r in sample_rows(coded.select("row", "code"), background, "row", seed + 1).collect()]  # at most ``background``
    others = np.frombuffer(b"".join(bytes(c) for c in pool), np.uint8).reshape(-1, len(names))
    sent = df.sparkSession.sparkContext.broadcast(LeafTables(others, boxes))

    def sums(codes: np.ndarray) -> np.ndarray:
        total = np.full(len(codes), start)
        for grown in fitted_trees:
            total += grown[3][boosting.leaf_of(grown, codes)]
        return total

    fitted_trees = [grown[0, 0, part].arrays() for grown in fitted.trees]
    base = float(sums(others).mean()) if len(others) else start

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, len(names))
            if len(own):
                values = sent.value.explain(own, len(names))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(list(values), pa.list_(pa.float64())), pa.array(sums(own))], names=["code", "shares", "prediction"]
                )

    # few bytes a row, much work: one partition of them would be one task
    different = coded.select("code").distinct().repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "code").mapInArrow(explain, "code binary, shares array<double>, prediction double")
    return coded, different, base


def tree_contributions(model: models.TabularModel, df: DataFrame, row_id: str, background: int = 100, class_index: int = 1, seed: int = 0) -> DataFrame:
    """Shapley values of all rows under boosted trees, exact against a background of ``background`` rows.

    What is explained is the sum of the trees: the prediction of a regression, the log odds of two classes, a class's score of more. Rows
    that fall into the same bins are one: each different row of bins is explained once, and the result joined back.
    Output: row, feature, value, contribution, base and prediction; per row contributions sum to prediction minus base.
    """
    return _each_share(*_explained(model, df, row_id, background, class_index, seed), model.prep.columns(), row_id)


def _each_share(coded: DataFrame, different: DataFrame, base: float, names: list[str], row_id: str) -> DataFrame:
    joined = coded.join(different, "code")
    each = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("x").alias("value"), F.col("shares").alias("contribution"))
    return joined.select(F.col("row").alias(row_id), F.inline(each), F.lit(base).alias("base"), "prediction")


def top_tree_contributions(
    model: models.TabularModel, df: DataFrame, row_id: str, top: int = 10, background: int = 100, class_index: int = 1, seed: int = 0
) -> DataFrame:
    """What :func:`top_contributions` says of :func:`tree_contributions`, ranked once per different row of bins.

    A row of an id of its own has the lines of its bins, so neither it nor its shares are moved; only ids are, to find those that come
    several times. The rows of these are ranked together, as a table of shares.
    """
    names = model.prep.columns()
    coded, different, base = _explained(model, df, row_id, background, class_index, seed)
    different = stored_round(different)
    named = F.zip_with(F.array(*[F.lit(n) for n in names]), "shares", lambda n, c: F.struct((-F.abs(c)).alias("less"), n.alias("feature"), c.alias("contribution")))
    ranked = different.select("code", F.sort_array(named).alias("all"))
    rest = F.aggregate(F.slice("all", top + 1, len(names)), F.lit(0.0), lambda total, s: total + s["contribution"])
    line = lambda place, feature, share: F.struct(place.alias("rank"), feature.alias("feature"), share.alias("contribution"))
    shown = F.transform(F.slice("all", 1, top), lambda s, i: line(i + 1, s["feature"], s["contribution"]))
    other = F.when(F.abs(rest) > 1e-12, F.array(line(F.lit(top + 1), F.lit("other"), rest))).otherwise(F.slice(shown, 1, 0))
    lines = ranked.select("code", F.concat(shown, other).alias("lines"))
    if different.count() <= SENT:
        lines = F.broadcast(lines)

    often = df.groupBy(F.col(row_id).alias("_often")).agg(F.count("*").alias("_n")).where("_n > 1").select("_often")
    often = stored_round(often)  # its size is known, so a few are sent to the rows
    repeats = coded["row"].eqNullSafe(often["_often"])
    own = coded.join(often, repeats, "left_anti").select("row", "code").join(lines, "code").select(F.col("row").alias(row_id), F.inline("lines"))
    shared = _each_share(coded.join(often, repeats, "left_semi"), different, base, names, row_id)
    return own.unionByName(top_contributions(shared, row_id, top))


def _output(model: models.TabularModel, class_index: int) -> Column:
    if model.task == models.CLASSIFICATION:
        return F.get(vector_to_array("probability"), F.lit(class_index))
    return F.col("prediction")


def mean_contributions(shares: DataFrame) -> DataFrame:
    return shares.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature")


def top_contributions(shares: DataFrame, row_id: str, top: int = 10) -> DataFrame:
    """Largest contributions of each row; the others summed in one line when they amount to anything."""
    place = F.row_number().over(Window.partitionBy(row_id).orderBy(F.desc(F.abs("contribution")), "feature"))
    ranked = shares.withColumn("rank", place)
    shown = ranked.where(F.col("rank") <= top).select(row_id, "rank", "feature", "contribution")
    others = ranked.where(F.col("rank") > top).groupBy(row_id).agg(F.sum("contribution").alias("contribution"))
    others = others.where(F.abs("contribution") > 1e-12).select(row_id, F.lit(top + 1).alias("rank"), F.lit("other").alias("feature"), "contribution")
    return shown.unionByName(others)


def with_noise(df: DataFrame, row_id: str, count: int, seed: int = 0) -> DataFrame:
    """Append normal columns that know nothing of the rows; the same row always gets the same numbers."""

    def uniform(i: int) -> Column:
        return (scatter(row_id, seed * 101 + i) + F.lit(1)) / F.lit(float(MODULUS) + 1)

    return df.withColumns(
        {
            f"noise_{i + 1}": F.sqrt(-2 * F.log(uniform(2 * i))) * F.cos(2 * F.pi() * uniform(2 * i + 1))
            for i in range(count)
        }
    )


def noise_probe(
    train: DataFrame, test: DataFrame, numeric: list[str], target: str, row_id: str, noise: int = 4, trees: int = 50, depth: int = 6,
    repeats: int = 5, seed: int = 0,
) -> DataFrame:
    """Both importances of real and appended random columns, and the share of the real ones."""
    names = numeric + [f"noise_{i + 1}" for i in range(noise)]
    pipeline = models.TabularPipeline(
        "forest", models.CLASSIFICATION, target, names, [], models.PreprocessConfig(numeric_impute="mean"), seed,
        {"n_estimators": trees, "max_depth": depth},
    )
    model = pipeline.fit(with_noise(train, row_id, noise, seed))
    own = model_importance(model, train.sparkSession)
    lost = permutation_importance(model, with_noise(test, row_id, noise, seed), names, row_id, repeats, seed)
    real = F.col("feature").isin(numeric)
    share = own.agg(F.sum(F.when(real, F.col("importance")).otherwise(0.0)) / F.greatest(F.sum("importance"), F.lit(1e-12))).scalar()
    return own.join(lost, "feature").withColumn("real", real).withColumn("real_share", share)
