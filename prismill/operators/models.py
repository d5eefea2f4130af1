"""Model registry: MLlib estimators behind short names, with penalties on the scale users know.

A model takes a table with a ``features`` vector and a numeric ``label`` and returns it with
``prediction`` (and ``probability`` where the model has one).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, classification as MC, regression as MR
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismill.operators import boosting, forests, neighbours
from prismill.operators.ordering import most_frequent
from prismill.operators.preprocess import PreprocessConfig, Preprocessor, PreprocessModel
from prismill.session import cut_lineage, stored_round

CLASSIFICATION, REGRESSION = "classification", "regression"
MOST_ROUNDS = (1 << 31) - 1  # no bound
DEALT_ROWS, TASK_ROWS = 5_000, 250_000  # rows a task gets at least, as far as there are tasks; at most
SIDE_BY_SIDE = 2_000_000  # rows up to which several models are fitted at the same time, and a forest's rows are dealt before they are merged


def baseline_mode(train: DataFrame, target: str) -> Column:
    """The training part's most frequent value, as a constant column."""
    return most_frequent(train, target).select(target).scalar()


def baseline_mean(train: DataFrame, target: str) -> Column:
    return train.agg(F.avg(target)).scalar()


@dataclass(frozen=True)
class TrainingFacts:
    """What a penalty needs to know of the training rows."""

    rows: int
    classes: int
    spread: float


def training_facts(train: DataFrame, task: str) -> TrainingFacts:
    classes = F.count_distinct("label") if task == CLASSIFICATION else F.lit(0)
    row = train.agg(F.count("*").alias("n"), classes.alias("k"), F.stddev_pop("label").alias("s")).first()
    return TrainingFacts(int(row["n"]), int(row["k"]), float(row["s"] or 1.0))


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """Rows dealt evenly over tasks, for a fit that passes over them many times: one small file is read by one task, however many cores there are.

    Few rows stay together, many are cut into parts that a task can hold.
    """
    parts = max(min(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // DEALT_ROWS)), -(-rows // TASK_ROWS), 1)
    return df.repartition(parts)


def _one_vs_rest(estimator: Estimator, facts: TrainingFacts) -> Estimator:
    return estimator if facts.classes <= 2 else MC.OneVsRest(classifier=estimator, parallelism=4)


def logistic(facts: TrainingFacts, C: float = 1.0, seed: int = 0) -> Estimator:
    """L2 penalty of strength 1/C on the summed loss."""
    return MC.LogisticRegression(regParam=1 / (C * facts.rows), elasticNetParam=0.0, standardization=False, maxIter=300, tol=1e-5)


def ridge(facts: TrainingFacts, alpha: float = 1.0, seed: int = 0) -> Estimator:
    """L2 penalty alpha on the summed squared error; MLlib divides it by the target's deviation, undone here."""
    return MR.LinearRegression(
        regParam=alpha * facts.spread / facts.rows, elasticNetParam=0.0, standardization=False, solver="normal"
    )


def lasso(facts: TrainingFacts, alpha: float = 1.0, seed: int = 0) -> Estimator:
    return MR.LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, maxIter=1000, tol=1e-9)


def least_squares(facts: TrainingFacts, seed: int = 0) -> Estimator:
    return MR.LinearRegression(regParam=0.0, solver="normal")


def linear_svm(facts: TrainingFacts, C: float = 1.0, seed: int = 0) -> Estimator:
    """The optimiser goes on until a round gains next to nothing, however many it takes."""
    return _one_vs_rest(MC.LinearSVC(regParam=1 / (C * facts.rows), standardization=False, maxIter=MOST_ROUNDS, tol=1e-6), facts)


def decision_tree(facts: TrainingFacts, max_depth: int = 4, min_samples_leaf: int = 1, seed: int = 0) -> Estimator:
    return MC.DecisionTreeClassifier(maxDepth=int(max_depth), minInstancesPerNode=int(min_samples_leaf), seed=seed)


def forest(facts: TrainingFacts, n_estimators: int = 100, max_depth: int = 8, seed: int = 0) -> Estimator:
    return MC.RandomForestClassifier(numTrees=int(n_estimators), maxDepth=int(max_depth), seed=seed)


def forest_regressor(facts: TrainingFacts, n_estimators: int = 200, max_depth: int = 12, seed: int = 0) -> Estimator:
    return MR.RandomForestRegressor(numTrees=int(n_estimators), maxDepth=int(max_depth), featureSubsetStrategy="all", seed=seed)


def bagged_trees(facts: TrainingFacts, n_estimators: int = 50, max_depth: int = 8, seed: int = 0) -> Estimator:
    return MC.RandomForestClassifier(numTrees=int(n_estimators), maxDepth=int(max_depth), featureSubsetStrategy="all", seed=seed)


class OnDealtRows(Estimator):
    """Fits on rows that are dealt and held, for a fit that reads them once for every level of its trees."""

    def __init__(self, estimator: Estimator, rows: int):
        super().__init__()
        self.estimator, self.rows = estimator, rows

    def _fit(self, df: DataFrame) -> Model:
        spread = dealt(df, self.rows).persist()
        try:
            return self.estimator.fit(spread)
        finally:
            spread.unpersist()


def deep_forest(facts: TrainingFacts, task: str, n_estimators: int = 200, max_depth: int = 12, seed: int = 0) -> Estimator:
    """Forest of deep trees: grown from cells of equal bins, by MLlib where there are too many of these."""
    build, classes = (forest, max(facts.classes, 2)) if task == CLASSIFICATION else (forest_regressor, 0)
    return forests.Forest(OnDealtRows(build(facts, n_estimators, max_depth, seed), facts.rows), classes, n_estimators, max_depth, seed)


class LeafwiseTrees(Estimator):
    """Boosted trees of :mod:`prismill.operators.boosting` over a ``features`` vector and a numeric ``label``."""

    def __init__(self, settings: boosting.Settings):
        super().__init__()
        self.settings = settings

    def _fit(self, df: DataFrame) -> "LeafwiseModel":
        width = len(df.select("features").first()["features"])
        names = [f"_x{i}" for i in range(width)]
        fitted = boosting.fit(_spread(df, names), [], names, "label", settings=self.settings)
        return LeafwiseModel(fitted)


class LeafwiseModel(Model):
    def __init__(self, fitted: boosting.Boosted):
        super().__init__()
        self.fitted = fitted

    @property
    def featureImportances(self) -> Vector:
        """Number of splits on each feature."""
        return Vectors.dense(list(self.fitted.importance().values()))

    def _transform(self, df: DataFrame) -> DataFrame:
        scores, settings = self.fitted.scorer(), self.fitted.settings

        @F.pandas_udf("array<double>")
        def scored(rows: pd.Series) -> pd.Series:
            if rows.empty:
                return pd.Series([], dtype=object)
            return pd.Series(list(scores(0, np.stack([np.asarray(r, float) for r in rows]))), index=rows.index)

        out = df.withColumn("_scores", scored(vector_to_array("features")))
        if settings.loss == boosting.SQUARED:
            return out.withColumn("prediction", F.get("_scores", F.lit(0))).drop("_scores")
        if settings.classes == 1:
            share = 1 / (1 + F.exp(-F.get("_scores", F.lit(0))))
            shares = F.array(1 - share, share)
        else:
            most = F.array_max("_scores")
            raised = F.transform("_scores", lambda s: F.exp(s - most))
            shares = F.transform(raised, lambda r: r / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))
        out = out.withColumn("_shares", shares)
        out = out.withColumn("prediction", (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double"))
        return out.withColumn("probability", array_to_vector("_shares")).drop("_scores", "_shares")


def _boost_settings(facts: TrainingFacts | None, task: str, classes: int, options: dict[str, Any]) -> boosting.Settings:
    named = {"n_estimators": "rounds", "learning_rate": "rate", "num_leaves": "leaves"}
    given = {named.get(k, k): v for k, v in options.items()}
    return boosting.Settings(loss=boosting.LOGISTIC if task == CLASSIFICATION else boosting.SQUARED, classes=classes if classes > 2 else 1, **given)


def boosted(facts: TrainingFacts, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3, seed: int = 0) -> Estimator:
    """Trees of a set depth, each level whole: as many leaves as it holds, from one row each."""
    depth = int(max_depth)
    options = {"n_estimators": int(n_estimators), "learning_rate": learning_rate, "max_depth": depth, "num_leaves": 1 << depth, "min_rows": 1}
    return LeafwiseTrees(_boost_settings(facts, CLASSIFICATION, facts.classes, options))


def boosted_classifier(facts: TrainingFacts, seed: int = 0, **options) -> Estimator:
    """300 trees of 31 leaves at rate 0.05, unless told otherwise."""
    return LeafwiseTrees(_boost_settings(facts, CLASSIFICATION, facts.classes, options))


def boosted_regressor(facts: TrainingFacts, seed: int = 0, **options) -> Estimator:
    return LeafwiseTrees(_boost_settings(facts, REGRESSION, 0, options))


class RandomFeatures(Estimator):
    """Radial kernel by random Fourier features: cosines of fixed projections, then a linear model."""

    def __init__(self, facts: TrainingFacts, C: float, gamma: float, n_features: int = 200, seed: int = 0):
        super().__init__()
        self.facts, self.C, self.gamma, self.n_features, self.seed = facts, C, gamma, n_features, seed

    def _fit(self, df: DataFrame) -> "RandomFeaturesModel":
        width = len(df.select("features").first()["features"])
        rng = np.random.default_rng(self.seed)
        w = rng.normal(size=(width, self.n_features)) * math.sqrt(2 * self.gamma)
        b = rng.uniform(0, 2 * math.pi, self.n_features)
        mapped = _project(df, w, b)
        return RandomFeaturesModel(w, b, linear_svm(self.facts, self.C).fit(mapped))


class RandomFeaturesModel(Model):
    def __init__(self, w: np.ndarray, b: np.ndarray, model: Model):
        super().__init__()
        self.w, self.b, self.model = w, b, model

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(_project(df.withColumn("_original", F.col("features")), self.w, self.b))
        return out.drop("features").withColumnRenamed("_original", "features")


def _project(df: DataFrame, w: np.ndarray, b: np.ndarray) -> DataFrame:
    scale = math.sqrt(2 / w.shape[1])

    @F.pandas_udf("array<double>")
    def cosines(rows: pd.Series) -> pd.Series:
        if rows.empty:
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(r, dtype=float) for r in rows])
        return pd.Series(list(scale * np.cos(x @ w + b)), index=rows.index)

    return df.withColumn("features", array_to_vector(cosines(vector_to_array("features"))))


def rbf_svm(facts: TrainingFacts, C: float = 1.0, gamma: float = 1.0, seed: int = 0) -> Estimator:
    return RandomFeatures(facts, C, gamma, seed=seed)


class NearestVote(Estimator):
    """k nearest neighbours; needs an integer ``row_id`` column."""

    def __init__(self, k: int, weights: str):
        super().__init__()
        self.k, self.weights = k, weights

    def _fit(self, df: DataFrame) -> "NearestVoteModel":
        return NearestVoteModel(df, self.k, self.weights)


class NearestVoteModel(Model):
    def __init__(self, train: DataFrame, k: int, weights: str):
        super().__init__()
        self.train, self.k, self.weights = train, k, weights

    def _transform(self, df: DataFrame) -> DataFrame:
        arrays = lambda d: d.withColumn("_v", vector_to_array("features"))
        votes = neighbours.knn_classify(arrays(self.train), arrays(df), "row_id", "_v", "label", self.k, self.weights)
        return df.join(votes.select("row_id", F.col("predicted").cast("double").alias("prediction")), "row_id")


def nearest_vote(facts: TrainingFacts, n_neighbors: int = 5, weights: str = "uniform", seed: int = 0) -> Estimator:
    return NearestVote(int(n_neighbors), weights)


class GaussianBayes(Estimator):
    def __init__(self, var_smoothing: float):
        super().__init__()
        self.var_smoothing = var_smoothing

    def _fit(self, df: DataFrame) -> "GaussianBayesModel":
        width = len(df.select("features").first()["features"])
        names = [f"_x{i}" for i in range(width)]
        wide = _spread(df, names)
        return GaussianBayesModel(names, neighbours.fit_naive_bayes(wide, names, "label", self.var_smoothing))


class GaussianBayesModel(Model):
    def __init__(self, names: list[str], numbers: list[tuple]):
        super().__init__()
        self.names, self.numbers = names, numbers

    def _transform(self, df: DataFrame) -> DataFrame:
        wide = neighbours.naive_bayes_classify(_spread(df, self.names), self.names, self.numbers, "prediction")
        return wide.drop(*self.names)


def _spread(df: DataFrame, names: list[str]) -> DataFrame:
    arrays = df.withColumn("_v", vector_to_array("features"))
    return arrays.withColumns({n: F.get("_v", F.lit(i)) for i, n in enumerate(names)}).drop("_v")


def gaussian_bayes(facts: TrainingFacts, var_smoothing: float = 1e-9, seed: int = 0) -> Estimator:
    return GaussianBayes(var_smoothing)


@dataclass(frozen=True)
class ModelSpec:
    key: str
    build: Callable[..., Estimator]
    scaled: bool
    defaults: dict[str, Any] = field(default_factory=dict)
    merges: bool = False  # rows of equal bins become one in a first pass


# The models and their default settings.
CLASSIFIERS = {
    s.key: s
    for s in (
        ModelSpec("logreg", logistic, True, {"C": 1.0}),
        ModelSpec("knn", nearest_vote, True, {"n_neighbors": 5, "weights": "uniform"}),
        ModelSpec("svm_linear", linear_svm, True, {"C": 1.0}),
        ModelSpec("svm_rbf", rbf_svm, True, {"C": 1.0, "gamma": 1.0}),
        ModelSpec("tree", decision_tree, False, {"max_depth": 4, "min_samples_leaf": 1}),
        ModelSpec("forest", forest, False, {"n_estimators": 100, "max_depth": 8}),
        ModelSpec("gbdt", boosted, False, {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3}, merges=True),
        ModelSpec("bagging", bagged_trees, False, {"n_estimators": 50, "max_depth": 8}),
        ModelSpec("gnb", gaussian_bayes, False, {"var_smoothing": 1e-9}),
    )
}
ENSEMBLE_STAGES = ("tree", "bagging", "forest", "gbdt")


def fit_classifier(key: str, train: DataFrame, numeric: list[str], params: dict[str, Any] | None = None, seed: int = 0) -> "TabularModel":
    """Fit a registry model on numeric columns and a numeric ``label``."""
    spec = CLASSIFIERS[key]
    config = PreprocessConfig(numeric_impute="mean", scale=spec.scaled)
    prep = Preprocessor(numeric, [], config).fit(train)
    settings = {**spec.defaults, **(params or {})}
    if spec.merges:  # few passes: a written table of two columns, rather than a checkpoint of all of them and a dealt copy in memory
        ready = stored_round(prep.transform(train).select("features", "label"))
        return TabularModel(prep, spec.build(training_facts(ready, CLASSIFICATION), seed=seed, **settings).fit(ready), CLASSIFICATION, [])
    ready = cut_lineage(prep.transform(train))  # fits read their rows many times
    facts = training_facts(ready, CLASSIFICATION)
    spread = dealt(ready, facts.rows).persist()
    try:
        model = spec.build(facts, seed=seed, **settings).fit(spread)
    finally:
        spread.unpersist()
    return TabularModel(prep, model, CLASSIFICATION, [])


def fit_classifiers(keys: Iterable[str], train: DataFrame, numeric: list[str], each: Callable[[str, Callable[..., TabularModel]], Any], seed: int = 0) -> list[Any]:
    """What ``each(key, fit)`` returns of models without scaling, as :func:`fit_classifier` fits them; ``fit`` takes the settings.

    All fit the same rows, which are prepared, dealt and held once, with no more columns than a fit reads. Of a large table one model is
    fitted at a time: the fits of a forest hold their rows once more, and fill all cores by themselves.
    """
    prep = Preprocessor(numeric, [], PreprocessConfig(numeric_impute="mean", scale=False)).fit(train)
    ready = prep.transform(train).select("features", "label")
    facts = training_facts(ready, CLASSIFICATION)
    spread = dealt(ready, facts.rows).persist()
    spread.count()  # held before the first fits begin, which start together

    def one(key: str) -> Any:
        spec = CLASSIFIERS[key]

        def fit(params: dict[str, Any] | None = None) -> TabularModel:
            settings = {**spec.defaults, **(params or {})}
            return TabularModel(prep, spec.build(facts, seed=seed, **settings).fit(spread), CLASSIFICATION, [])

        return each(key, fit)

    try:
        with ThreadPoolExecutor(max_workers=4 if facts.rows <= SIDE_BY_SIDE else 1) as pool:
            return [f.result() for f in [pool.submit(inheritable_thread_target(train.sparkSession)(one), key) for key in keys]]
    finally:
        spread.unpersist()


# --- tables with a target column ----------------------------------------------------


class _Constant(Model):
    def __init__(self, value: float, classes: int):
        super().__init__()
        self.value, self.classes = value, classes

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("prediction", F.lit(self.value))
        if self.classes:
            shares = [F.lit(1.0 if i == self.value else 0.0) for i in range(self.classes)]
            out = out.withColumn("probability", array_to_vector(F.array(*shares)))
        return out


# model key -> (tree based, classifier, regressor)
TABULAR = {
    "boosted": (True, lambda f, s, **o: boosted_classifier(f, seed=s, **o), lambda f, s, **o: boosted_regressor(f, seed=s, **o)),
    "forest": (True, lambda f, s, **o: deep_forest(f, CLASSIFICATION, seed=s, **o), lambda f, s, **o: deep_forest(f, REGRESSION, seed=s, **o)),
    "linear": (False, lambda f, s, **o: logistic(f, seed=s, **o), lambda f, s, **o: ridge(f, seed=s, **o)),
    "baseline": (False, None, None),
}


MERGING = ("boosted", "forest")  # rows of equal bins become one in a first pass, so preparing a row anew is less than holding it


class TabularPipeline(Estimator):
    """Preprocessing and a model as one unit, so that a fold never sees another fold's medians or levels."""

    def __init__(
        self, key: str, task: str, target: str, numeric: list[str], categorical: list[str],
        config: PreprocessConfig = PreprocessConfig(), seed: int = 0, options: dict[str, Any] | None = None,
    ):
        super().__init__()
        self.key, self.task, self.target = key, task, target
        self.numeric, self.categorical, self.seed = numeric, categorical, seed
        self.options = options or {}
        tree = TABULAR[key][0]
        self.config = PreprocessConfig(config.numeric_impute, config.categorical_impute, config.scale and not tree, config.encode)

    def _fit(self, df: DataFrame) -> "TabularModel":
        labels: list[str] = []
        known = df.where(F.col(self.target).isNotNull())
        if self.task == CLASSIFICATION:
            # one string per class
            labels = [r[0] for r in known.select(F.col(self.target).cast("string")).distinct().orderBy(self.target).collect()]
        prep = Preprocessor(self.numeric, self.categorical, self.config).fit(known)
        ready = prep.transform(with_label(known, self.target, labels)).select("features", "label")
        if self.key in MERGING:
            return TabularModel(prep, self._model(ready, labels), self.task, labels, self.target)
        ready = ready.persist()
        try:
            model = self._model(ready, labels)
        finally:
            ready.unpersist()
        return TabularModel(prep, model, self.task, labels, self.target)

    def _model(self, ready: DataFrame, labels: list[str]) -> Model:
        if self.key == "baseline":
            if self.task == CLASSIFICATION:
                return _Constant(most_frequent(ready, "label").first()["label"], len(labels))
            return _Constant(ready.agg(F.avg("label")).first()[0], 0)
        build = TABULAR[self.key][1 if self.task == CLASSIFICATION else 2]
        facts = training_facts(ready, self.task)
        estimator = build(facts, self.seed, **self.options)
        if self.key != "forest" or facts.rows > SIDE_BY_SIDE:
            return estimator.fit(ready)
        return OnDealtRows(estimator, facts.rows).fit(ready)  # one small file would be read by one task


def with_label(df: DataFrame, target: str, labels: list[str]) -> DataFrame:
    """Numeric ``label`` column: the class's place in the sorted list, or the value itself."""
    if not labels:
        return df.withColumn("label", F.col(target).cast("double"))
    names = F.array(*[F.lit(v) for v in labels])
    return df.withColumn("label", (F.array_position(names, F.col(target).cast("string")) - 1).cast("double"))


class TabularModel(Model):
    def __init__(self, prep: PreprocessModel, model: Model, task: str, labels: list[str], target: str | None = None):
        super().__init__()
        self.prep, self.model, self.task, self.labels, self.target = prep, model, task, labels, target

    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, the numeric ``label`` when the target is there, and ``predicted`` class names."""
        if self.target and self.target in df.columns:
            df = with_label(df, self.target, self.labels)
        out = self.model.transform(self.prep.transform(df))
        if self.labels:
            names = F.array(*[F.lit(v) for v in self.labels])
            out = out.withColumn("predicted", F.get(names, F.col("prediction").cast("int")))
        return out


class Formula(Model):
    """A given formula as a model: what it says of a row is the prediction."""

    def __init__(self, formula: Column, target: str, task: str = REGRESSION):
        super().__init__()
        self.formula, self.target, self.task = formula, target, task

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"label": F.col(self.target).cast("double"), "prediction": self.formula.cast("double")})
