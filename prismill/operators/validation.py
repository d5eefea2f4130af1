"""Cross-validation, model comparison, parameter sweeps."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismill.operators import boosting, metrics, models, pixels
from prismill.operators.clustering import vectors
from prismill.operators.forecasting import regression_scores
from prismill.operators.preprocess import PreprocessConfig, Preprocessor
from prismill.operators.splits import shuffled_folds
from prismill.session import cut_lineage

# Tree counts the growth curve tries, the gap that counts as level with the best.
GROWTH_COUNTS = (1, 2, 3, 5, 8, 12, 20, 30, 50, 75, 100, 150, 200)
PLATEAU_GAP = 0.005
MAX_DEGREE = 15


def side_by_side(spark: SparkSession, jobs: Iterable[Callable[[], Any]], parallelism: int = 4) -> list[Any]:
    """Run independent fits at the same time, so that small stages of one fill the gaps of another."""
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def score(predictions: DataFrame, task: str) -> float | None:
    """Accuracy, or R2 for regression."""
    if task == models.CLASSIFICATION:
        value = predictions.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    else:
        value = metrics.regression_report(predictions, "label", "prediction").first()["r2"]
    return None if value is None else float(value)


def accuracy(predictions: DataFrame) -> float:
    return float(score(predictions, models.CLASSIFICATION))


def cross_validate(
    pipeline: Estimator, df: DataFrame, row_id: str, task: str, target: str, splits: int = 5, seed: int = 0, parallelism: int = 4
) -> list[float]:
    """Fold scores of a pipeline refitted without each fold; classes keep their shares in every fold."""
    folded = shuffled_folds(df, row_id, splits, target if task == models.CLASSIFICATION else None, seed).persist()

    def one(i: int) -> float:
        model = pipeline.fit(folded.where(F.col("fold") != i))
        return score(model.transform(folded.where(F.col("fold") == i)), task)

    try:
        return side_by_side(df.sparkSession, [lambda i=i: one(i) for i in range(splits)], parallelism)
    finally:
        folded.unpersist()


def cross_validate_models(
    keys: Iterable[str], df: DataFrame, row_id: str, task: str, target: str, numeric: list[str], categorical: list[str],
    config: PreprocessConfig = PreprocessConfig(), splits: int = 5, seed: int = 0, options: dict[str, dict] | None = None,
) -> DataFrame:
    """Fold scores of several models: (model, fold, score)."""
    rows = []
    for key in keys:
        if key == "boosted":
            folds = boosted_folds(df, row_id, task, target, numeric, categorical, config, splits, seed, (options or {}).get(key))
            rows += [(key, i, s) for i, s in enumerate(folds)]
            continue
        pipeline = models.TabularPipeline(key, task, target, numeric, categorical, config, seed, (options or {}).get(key))
        rows += [(key, i, s) for i, s in enumerate(cross_validate(pipeline, df, row_id, task, target, splits, seed))]
    return df.sparkSession.createDataFrame(rows, "model string, fold int, score double")


def boosted_folds(
    df: DataFrame, row_id: str, task: str, target: str, numeric: list[str], categorical: list[str],
    config: PreprocessConfig = PreprocessConfig(), splits: int = 5, seed: int = 0, options: dict[str, Any] | None = None,
) -> list[float]:
    """Fold scores of boosted trees as :func:`cross_validate` has them, with all folds in the same jobs.

    Every fold's model sees features prepared by what its own training rows say.
    """
    kind = models.CLASSIFICATION if task == models.CLASSIFICATION else None
    folded = shuffled_folds(df, row_id, splits, target if kind else None, seed).where(F.col(target).isNotNull())
    labels = [r[0] for r in folded.select(F.col(target).cast("string")).distinct().orderBy(target).collect()] if kind else []  # a string per class
    used = [*numeric, *categorical]
    rows = models.with_label(folded, target, labels).select(row_id, "fold", "label", *used).persist()
    try:
        plain = PreprocessConfig(config.numeric_impute, config.categorical_impute, False, config.encode)
        ready, widths = rows.withColumn("_raw", F.struct(*used)), []
        for i in range(splits):
            prep = Preprocessor(numeric, categorical, plain, f"_view{i}").fit(rows.where(F.col("fold") != i))
            widths.append(len(prep.columns()))
            kept = [c for c in ready.columns if c not in used]
            ready = prep.transform(ready.select(*kept, "_raw.*")).withColumn(f"_view{i}", vector_to_array(f"_view{i}"))
        width = max(widths)
        views = {f"_view{i}": F.concat(f"_view{i}", F.array_repeat(F.lit(float("nan")), width - w)) for i, w in enumerate(widths)}
        settings = models._boost_settings(None, task, len(labels), options or {})
        names = [f"x{i}" for i in range(width)]
        fitted = boosting.fit(ready.withColumns(views), [], names, "label", "fold", splits, False, row_id, settings, list(views))
        out = boosting.out_of_fold(fitted, df.sparkSession)
        best = F.array_position("scores", F.array_max("scores")) - 1 if settings.classes > 1 else (F.get("scores", F.lit(0)) > 0).cast("int")
        guess = best.cast("double") if kind else F.get("scores", F.lit(0))
        scored = out.select("fold", F.col("target").alias("label"), guess.alias("prediction"))
        if kind:
            value = F.avg((F.col("prediction") == F.col("label")).cast("double"))
        else:
            value = regression_scores(F.col("label"), F.col("prediction"))[0]
        found = {r["fold"]: r["s"] for r in scored.groupBy("fold").agg(value.alias("s")).collect()}
        fitted.rows.unpersist()
        return [found.get(i) for i in range(splits)]
    finally:
        rows.unpersist()


def compare_scores(scores: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Per model: mean, population spread, range, gain over the baseline and whether the spread exceeds the gain."""
    rows = scores.groupBy("model").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"), F.min("score").alias("low"), F.max("score").alias("high")
    )
    base = rows.where(F.col("model") == baseline).select("mean").scalar()
    gained = rows.withColumn("gain", F.col("mean") - base)
    return gained.withColumn("within_spread", F.col("spread") > F.abs("gain"))


def hold_out_scores(predictions: DataFrame, task: str) -> DataFrame:
    """The metrics of a hold-out: accuracy, macro F1 and AUC, or R2, RMSE and MAE."""
    if task == models.REGRESSION:
        return metrics.regression_report(predictions, "label", "prediction").select("r2", "rmse", "mae")
    out = metrics.classification_scores(predictions, "label", "prediction")
    if "probability" not in predictions.columns:
        return out.withColumn("auc", F.lit(None).cast("double"))
    shares = predictions.select("label", F.posexplode(vector_to_array("probability")).alias("class", "share"))
    ones = shares.withColumn("y", (F.col("label") == F.col("class")).cast("int"))
    per_class = metrics.roc_auc(metrics.score_steps(ones, "y", "share", ["class"]), ["class"])
    return out.withColumn("auc", metrics.macro_auc(per_class).select("auc").scalar())


def parameter_sweep(
    key: str, train: DataFrame, test: DataFrame, numeric: list[str], name: str, values: Iterable[Any], params: dict | None = None
) -> DataFrame:
    """Training and test accuracy for each value of one setting."""
    values = list(values)

    def one(value: Any) -> tuple:
        model = models.fit_classifier(key, train, numeric, {**(params or {}), name: value})
        return str(value), accuracy(model.transform(train)), accuracy(model.transform(test))

    rows = side_by_side(train.sparkSession, [lambda v=v: one(v) for v in values])
    return train.sparkSession.createDataFrame(rows, "value string, train_accuracy double, test_accuracy double")


def ensemble_stages(train: DataFrame, test: DataFrame, numeric: list[str], n_estimators: int = 50, max_depth: int = 6) -> DataFrame:
    """One tree, bagged trees, forest and boosting on the same split; boosting stays at depth 8 or less."""

    def one(key: str, fit: Callable[..., models.TabularModel]) -> tuple:
        defaults = models.CLASSIFIERS[key].defaults
        params = {n: v for n, v in (("n_estimators", n_estimators), ("max_depth", max_depth)) if n in defaults}
        if key == "gbdt":
            params["max_depth"] = min(max_depth, 8)
        model = fit(params)
        return key, accuracy(model.transform(train)), accuracy(model.transform(test))

    rows = models.fit_classifiers(models.ENSEMBLE_STAGES, train, numeric, one)
    return train.sparkSession.createDataFrame(rows, "stage string, train_accuracy double, test_accuracy double")


def forest_growth(train: DataFrame, test: DataFrame, numeric: list[str], counts: Iterable[int] = GROWTH_COUNTS, max_depth: int = 6) -> DataFrame:
    out = parameter_sweep("forest", train, test, numeric, "n_estimators", counts, {"max_depth": max_depth})
    return out.withColumn("trees", F.col("value").cast("int")).drop("value")


def plateau(growth: DataFrame) -> DataFrame:
    """The smallest tree count whose test accuracy is level with the best."""
    best = growth.agg(F.max("test_accuracy")).scalar()
    return growth.where(F.col("test_accuracy") >= best - PLATEAU_GAP).agg(F.min("trees").alias("trees"))


def classify_images(
    df: DataFrame, method: str, image: str = "image", row_id: str = "row_id", splits: int = 5, C: float = 10.0, kernel: str = "linear", side: int = 8
) -> tuple[int, float]:
    """Number of features of a feature set and the accuracy of out-of-fold predictions from it.

    ``kernel="rbf"`` takes the radial kernel (one fit per class), ``"linear"`` one multinomial fit.
    """
    ready = vectors(pixels.image_features(df, image, method, side, side, out="_f"), ["_f"], "_v")
    folded = shuffled_folds(ready, row_id, splits, "label").persist()
    width = len(folded.select("_v").first()["_v"])

    def one(i: int) -> int:
        train, test = folded.where(F.col("fold") != i), folded.where(F.col("fold") == i)
        scaler = StandardScaler(inputCol="_v", outputCol="features", withMean=True).fit(train)
        train = scaler.transform(train).select("features", "label")
        facts = models.training_facts(train, models.CLASSIFICATION)
        spread = models.dealt(train, facts.rows).persist()  # a fit has a round of tasks for each of its few hundred steps
        # a kernel width of one over the number of standardised features
        learner = models.rbf_svm(facts, C, 1.0 / width) if kernel == "rbf" else models.logistic(facts, C)
        try:
            model = learner.fit(spread)
        finally:
            spread.unpersist()
        return model.transform(scaler.transform(test)).where("prediction = label").count()

    right = sum(side_by_side(df.sparkSession, [lambda i=i: one(i) for i in range(splits)]))
    total = folded.count()
    folded.unpersist()
    return width, right / total


# --- polynomial fits ------------------------------------------------------------------

FITS = {"none": models.least_squares, "ridge": models.ridge, "lasso": models.lasso}


def fit_polynomial(train: DataFrame, x: str, y: str, degree: int, kind: str = "none", alpha: float = 1.0) -> models.TabularModel:
    """Powers 1..degree, standardised, then a linear fit."""
    names = [f"p{i}" for i in range(1, degree + 1)]
    rows = with_powers(train, x, degree).withColumn("label", F.col(y).cast("double"))
    prep = models.Preprocessor(names, [], PreprocessConfig(numeric_impute="mean")).fit(rows)
    ready = prep.transform(rows)
    facts = models.training_facts(ready, models.REGRESSION)
    estimator = FITS[kind](facts) if kind == "none" else FITS[kind](facts, alpha=alpha)
    return models.TabularModel(prep, estimator.fit(ready), models.REGRESSION, [])


def with_powers(df: DataFrame, x: str, degree: int) -> DataFrame:
    return df.withColumns({f"p{i}": F.pow(F.col(x).cast("double"), F.lit(i)) for i in range(1, degree + 1)})


def _mse(model: models.TabularModel, df: DataFrame, x: str, y: str, degree: int) -> float:
    out = model.transform(with_powers(df, x, degree).withColumn("label", F.col(y).cast("double")))
    return float(out.agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0])


def polynomial_errors(train: DataFrame, test: DataFrame, x: str, y: str, degree: int, kind: str = "none", alpha: float = 1.0) -> dict:
    """Training and test error and how many coefficients are zero."""
    model = fit_polynomial(train, x, y, degree, kind, alpha)
    zeros = int(sum(abs(c) < 1e-10 for c in model.model.coefficients))
    return {
        "degree": degree, "train_mse": _mse(model, train, x, y, degree), "test_mse": _mse(model, test, x, y, degree), "zero_coefficients": zeros,
    }


def degree_sweep(
    train: DataFrame, test: DataFrame, x: str, y: str, row_id: str, degrees: Iterable[int] = range(1, MAX_DEGREE + 1),
    kind: str = "none", alpha: float = 1.0,
) -> DataFrame:
    """Training, test and cross-validated error per degree.

    The rows are stored before the first of about six fits a degree, which would each work them out again.
    """
    train, test = cut_lineage(train.select(row_id, x, y)), cut_lineage(test.select(x, y))
    n = train.count()
    splits = max(2, min(5, n // 3))
    folded = cut_lineage(shuffled_folds(train, row_id, splits))

    def one(d: int) -> tuple:
        row = polynomial_errors(train, test, x, y, d, kind, alpha)
        folds = [
            _mse(fit_polynomial(folded.where(F.col("fold") != i), x, y, d, kind, alpha), folded.where(F.col("fold") == i), x, y, d)
            for i in range(splits)
        ]
        return d, row["train_mse"], row["test_mse"], sum(folds) / splits

    rows = side_by_side(train.sparkSession, [lambda d=d: one(d) for d in degrees])
    return train.sparkSession.createDataFrame(rows, "degree int, train_mse double, test_mse double, cv_mse double")


def best_degree(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy("cv_mse", "degree").limit(1).select("degree", "cv_mse")
