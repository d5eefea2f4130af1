"""Look-ahead-free features, forecast baselines, rolling-origin backtests."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismill.operators import boosting
from prismill.operators.series import by_time

# The horizons a sweep tries.
HORIZONS = (1, 3, 7, 14, 30, 60, 90)
BASELINES = ("naive", "seasonal_naive", "mean")


def feature_names(n_lags: int = 7, windows: tuple[int, ...] = (7, 28), calendar: bool = True) -> list[str]:
    names = [f"lag_{k}" for k in range(1, n_lags + 1)]
    for w in windows:
        names += [f"mean_{w}", f"std_{w}"]
    return names + (["month", "weekday", "year_sin", "year_cos"] if calendar else [])


def _feature_columns(keys: list[str], n_lags: int, windows: tuple[int, ...], calendar: bool) -> list[Column]:
    w = by_time(keys)
    columns = [F.lag("value", k).over(w).alias(f"lag_{k}") for k in range(1, n_lags + 1)]
    for size in windows:
        past = w.rowsBetween(-size, -1)
        full = F.count("value").over(past) == size
        columns.append(F.when(full, F.avg("value").over(past)).alias(f"mean_{size}"))
        columns.append(F.when(full, F.stddev_samp("value").over(past)).alias(f"std_{size}"))
    if calendar:
        angle = 2 * F.pi() * F.dayofyear("ts") / 365.25
        columns += [
            F.month("ts").alias("month"),
            F.weekday("ts").alias("weekday"),
            F.sin(angle).alias("year_sin"),
            F.cos(angle).alias("year_cos"),
        ]
    return columns


def make_features(
    series: DataFrame,
    keys: list[str],
    n_lags: int = 7,
    windows: tuple[int, ...] = (7, 28),
    calendar: bool = True,
    horizon: int = 1,
) -> DataFrame:
    """Lags, past-only rolling statistics, calendar columns and the target ``horizon`` points later.

    Features never use the value of their own row; rows with anything missing go.
    """
    columns = _feature_columns(keys, n_lags, windows, calendar)
    target = F.lead("value", horizon).over(by_time(keys)).alias("target")
    out = series.where(F.col("value").isNotNull()).select(*keys, "ts", "value", *columns, target)
    return out.dropna(subset=feature_names(n_lags, windows, calendar) + ["target"])


def add_baselines(series: DataFrame, keys: list[str], horizon: int, period: int) -> DataFrame:
    """Add the predictions that need no training, as of each row."""
    if horizon > period:
        raise ValueError("a seasonal naive forecast beyond one period would read the future")
    w = by_time(keys)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return series.select(
        "*",
        F.col("value").alias("naive"),
        F.lag("value", period - horizon).over(w).alias("seasonal_naive"),
        F.avg("value").over(so_far).alias("mean"),
    )


def with_test_fold(rows: DataFrame, keys: list[str], splits: int = 5) -> DataFrame:
    """Add the fold (1..splits) that tests each row, 0 for rows that only train.

    Fold i trains on everything before its test block; the rows left over by the division
    belong to the first training block.
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    placed = rows.withColumn("_i", F.row_number().over(by_time(keys)) - 1).withColumn("_n", n)
    size = F.floor(F.col("_n") / (splits + 1))
    first = F.col("_n") - splits * size
    fold = F.when(F.col("_i") >= first, F.floor((F.col("_i") - first) / size) + 1).otherwise(0)
    return placed.withColumn("fold", fold.cast("int")).drop("_i", "_n")


def fold_ranges(rows: DataFrame, keys: list[str], splits: int = 5) -> DataFrame:
    """Training and test span and size of every fold."""
    placed = with_test_fold(rows, keys, splits)
    blocks = placed.groupBy(*keys, "fold").agg(
        F.min("ts").alias("_a"), F.max("ts").alias("_b"), F.count("*").alias("_n")
    )
    before = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(
        *keys, "fold",
        F.min("_a").over(before).alias("train_start"), F.max("_b").over(before).alias("train_end"),
        F.col("_a").alias("test_start"), F.col("_b").alias("test_end"),
        F.sum("_n").over(before).alias("train_rows"), F.col("_n").alias("test_rows"),
    ).where("fold > 0")


def regression_scores(actual: Column, predicted: Column) -> list[Column]:
    """R2, RMSE and MAE over finite pairs, null for fewer than two; R2 of a constant target is null."""
    good = actual.isNotNull() & predicted.isNotNull() & ~F.isnan(actual) & ~F.isnan(predicted)
    a = F.when(good, actual)
    miss = F.when(good, actual - predicted)
    enough = F.count(a) >= 2
    spread = F.var_pop(a)
    return [
        F.when(enough & (spread > 0), 1 - F.avg(miss * miss) / spread).alias("r2"),
        F.when(enough, F.sqrt(F.avg(miss * miss))).alias("rmse"),
        F.when(enough, F.avg(F.abs(miss))).alias("mae"),
    ]


def _long_predictions(rows: DataFrame, methods: tuple[str, ...], kept: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("predicted")) for m in methods])
    return rows.select(*kept, F.inline(pairs))


def backtest_baselines(
    series: DataFrame, keys: list[str], horizon: int = 1, period: int = 365, splits: int = 5,
    n_lags: int = 7, windows: tuple[int, ...] = (7, 28), methods: tuple[str, ...] = BASELINES,
) -> DataFrame:
    """Scores per key, method and fold for the untrained forecasts: one grouped aggregate."""
    based = add_baselines(series, keys, horizon, period)
    columns = _feature_columns(keys, n_lags, windows, False)
    target = F.lead("value", horizon).over(by_time(keys)).alias("target")
    rows = based.select("*", *columns, target).dropna(subset=feature_names(n_lags, windows, False) + ["target"])
    tested = with_test_fold(rows.select(*keys, "ts", "target", *methods), keys, splits).where("fold > 0")
    long = _long_predictions(tested, methods, [*keys, "fold", "target"])
    return long.groupBy(*keys, "method", "fold").agg(*regression_scores(F.col("target"), F.col("predicted")))


def horizon_sweep(
    series: DataFrame, keys: list[str], period: int = 365, horizons: tuple[int, ...] = HORIZONS, splits: int = 5,
    n_lags: int = 7, windows: tuple[int, ...] = (7, 28), methods: tuple[str, ...] = ("naive", "seasonal_naive"),
) -> DataFrame:
    """Mean fold scores per horizon and method, all horizons in one job.

    Horizons that leave fewer than two rows per split are skipped.
    """
    if max(horizons) > period and "seasonal_naive" in methods:
        raise ValueError("a seasonal naive forecast beyond one period would read the future")
    w = by_time(keys)
    columns = _feature_columns(keys, n_lags, windows, False)
    ready = feature_names(n_lags, windows, False)
    per_horizon = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"),
                F.lead("value", h).over(w).alias("target"),
                F.lag("value", max(period - h, 0)).over(w).alias("seasonal_naive"),
            )
            for h in horizons
        ]
    )
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    wide = series.select(
        *keys, "ts", F.col("value").alias("naive"), F.avg("value").over(so_far).alias("mean"), *columns, per_horizon.alias("_h")
    ).dropna(subset=ready)
    rows = wide.select(*keys, "ts", "naive", "mean", F.inline("_h")).where("target IS NOT NULL")
    group = [*keys, "horizon"]
    sized = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*group))).where(F.col("_n") >= 2 * splits)
    tested = with_test_fold(sized.drop("_n"), group, splits).where("fold > 0")
    long = _long_predictions(tested, methods, [*group, "fold", "target"])
    folds = long.groupBy(*group, "method", "fold").agg(*regression_scores(F.col("target"), F.col("predicted")))
    return folds.groupBy(*group, "method").agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))


def best_by_horizon(sweep: DataFrame, keys: list[str], reference: str = "naive") -> DataFrame:
    """Best method per horizon and its gain over the reference method."""
    base = F.max(F.when(F.col("method") == reference, F.col("r2")))
    best = F.max(F.struct("r2", "method"))
    return sweep.where("r2 IS NOT NULL").groupBy(*keys, "horizon").agg(best.alias("_b"), base.alias("_r")).select(
        *keys, "horizon", F.col("_b.method").alias("method"), F.col("_b.r2").alias("r2"), (F.col("_b.r2") - F.col("_r")).alias("gain")
    )


def fold_summary(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Mean scores per method, best first; the spread is the population deviation over folds."""
    return folds.groupBy(*keys, "method").agg(
        F.avg("r2").alias("r2"), F.stddev_pop("r2").alias("spread"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae")
    ).orderBy(F.desc_nulls_last("r2"), "method")


# --- trained forecasters -------------------------------------------------------


def _ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    mean_x, mean_y = x.mean(axis=0), y.mean()
    xc = x - mean_x
    weights = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - mean_y))
    return weights, float(mean_y - mean_x @ weights)


def _out_fields(features: DataFrame, keys: list[str], names: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([features.schema[k] for k in keys] + [T.StructField(n, t) for n, t in names])


def ridge_predictions(
    features: DataFrame, keys: list[str], names: list[str], splits: int = 5, alpha: float = 1.0
) -> DataFrame:
    """Out-of-fold ridge forecasts, one small linear solve per series and fold.

    A group is one series of grid points; thousands of series fit side by side.
    """
    placed = with_test_fold(features, keys, splits)
    out = _out_fields(
        placed, keys,
        [("ts", placed.schema["ts"].dataType), ("fold", T.IntegerType()), ("target", T.DoubleType()), ("predicted", T.DoubleType())],
    )

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts")
        x, y = part[names].to_numpy(dtype=float), part["target"].to_numpy(dtype=float)
        fold = part["fold"].to_numpy()
        predicted = np.full(len(y), np.nan)
        for i in range(1, splits + 1):
            train, test = fold < i, fold == i
            if test.any() and train.any():
                weights, start = _ridge(x[train], y[train], alpha)
                predicted[test] = x[test] @ weights + start
        return part[[*keys, "ts", "fold", "target"]].assign(predicted=predicted)[fold > 0]

    return _by_series(placed, keys).applyInPandas(fit, out)


def _by_series(rows: DataFrame, keys: list[str]):
    """One group per series; without keys the whole table would be one group of one task."""
    if not keys:
        raise ValueError("name the columns that tell the series apart")
    return rows.groupBy(*keys)


def _all_horizons(series: DataFrame, keys: list[str], horizons: tuple[int, ...], splits: int, **features) -> tuple[DataFrame, list[str]]:
    """Features of all horizons that have enough rows as one table, and the features' names."""
    group = [*keys, "horizon"]
    tables = [make_features(series, keys, horizon=h, **features).withColumn("horizon", F.lit(h)) for h in horizons]
    names = [c for c in tables[0].columns if c not in (*group, "ts", "value", "target")]
    rows = reduce(DataFrame.unionByName, tables).withColumn("_n", F.count("*").over(Window.partitionBy(*group)))
    return rows.where(F.col("_n") >= 2 * splits).drop("_n"), names


def ridge_sweep(
    series: DataFrame, keys: list[str], horizons: tuple[int, ...] = HORIZONS, splits: int = 5, alpha: float = 1.0, **features,
) -> DataFrame:
    """Mean fold scores of the ridge forecast per horizon, in the shape of :func:`horizon_sweep`.

    The features of all horizons are one table, so each series and horizon is one small solve of the same job. Horizons
    that leave fewer than two rows per split are skipped.
    """
    group = [*keys, "horizon"]
    rows, names = _all_horizons(series, keys, horizons, splits, **features)
    out_of_fold = ridge_predictions(rows, group, names, splits, alpha)
    folds = score_predictions(out_of_fold, group, "ridge")
    return folds.groupBy(*group, "method").agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))


def ridge_importance(features: DataFrame, keys: list[str], names: list[str], alpha: float = 1.0) -> DataFrame:
    """Absolute ridge coefficients of a fit on all rows, per series."""
    out = _out_fields(features, keys, [("feature", T.StringType()), ("importance", T.DoubleType())])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        weights, _ = _ridge(part[names].to_numpy(dtype=float), part["target"].to_numpy(dtype=float), alpha)
        rows = pd.DataFrame({"feature": names, "importance": np.abs(weights)})
        for key in keys:
            rows[key] = part[key].iloc[0]
        return rows[[*keys, "feature", "importance"]]

    return _by_series(features, keys).applyInPandas(fit, out)


def boosted_predictions(
    features: DataFrame, keys: list[str], names: list[str], splits: int = 5, settings: boosting.Settings = boosting.Settings(),
) -> DataFrame:
    """Out-of-fold boosted-tree forecasts, a model per series and fold, all of them grown by the same jobs."""
    moment = features.schema["ts"].dataType
    placed = with_test_fold(features, keys, splits).withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    fitted = boosting.fit(placed, keys, names, "target", "fold", splits, True, "_at", settings)
    out = boosting.out_of_fold(fitted, features.sparkSession)
    return out.select(*keys, F.timestamp_micros("row").cast(moment).alias("ts"), "fold", "target", F.get("scores", F.lit(0)).alias("predicted"))


def boosted_sweep(
    series: DataFrame, keys: list[str], horizons: tuple[int, ...] = HORIZONS, splits: int = 5, settings: boosting.Settings = boosting.Settings(), **features,
) -> DataFrame:
    """Mean fold scores of the boosted forecast per horizon, in the shape of :func:`horizon_sweep`: horizons, folds and series are
    keys of one fit. Horizons that leave fewer than two rows per split are skipped."""
    group = [*keys, "horizon"]
    rows, names = _all_horizons(series, keys, horizons, splits, **features)
    folds = score_predictions(boosted_predictions(rows, group, names, splits, settings), group, "boosted")
    return folds.groupBy(*group, "method").agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))


def boosted_importance(features: DataFrame, keys: list[str], names: list[str], settings: boosting.Settings = boosting.Settings()) -> DataFrame:
    """Number of splits on each feature in a boosted fit on all rows, per series."""
    fitted = boosting.fit(features, keys, names, "target", settings=settings)
    rows = [(*key, name, value) for i, key in enumerate(fitted.keys) for name, value in fitted.importance(i).items()]
    schema = T.StructType([*fitted.kinds, T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])
    return features.sparkSession.createDataFrame(rows, schema)


def score_predictions(predictions: DataFrame, keys: list[str], method: str) -> DataFrame:
    """Fold scores of out-of-fold forecasts, in the shape of the baseline scores."""
    return predictions.groupBy(*keys, "fold").agg(
        *regression_scores(F.col("target"), F.col("predicted"))
    ).withColumn("method", F.lit(method))
