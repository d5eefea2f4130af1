"""Time-series invariants on seeded series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismill.operators import forecasting as FC
from prismill.operators import series as S

KEY = ["series"]


def frame(spark, values, name="a", start="2020-01-01"):
    ts = pd.date_range(start, periods=len(values)).date
    return spark.createDataFrame(pd.DataFrame({"series": name, "ts": ts, "value": np.asarray(values, dtype=float)}))


def seasonal(n=1200, seed=0):
    t = np.arange(n)
    return 15 + 0.002 * t + 10 * np.sin(2 * np.pi * t / 365) + np.random.default_rng(seed).normal(size=n)


def test_gap_is_filled_with_the_last_value(spark):
    df = frame(spark, np.arange(60.0)).where(~F.dayofmonth("ts").isin(11, 12, 13) | (F.month("ts") != 1))
    assert S.count_gaps(df, KEY, "ts", "value").collect() == [("a", 3, 60)]
    rows = S.build_series(df, KEY, "ts", "value").orderBy("ts").toPandas()
    assert len(rows) == 60 and list(rows["value"][9:14]) == [9, 9, 9, 9, 13]


def test_empty_bins_of_a_sum_are_zero(spark):
    df = frame(spark, [1.0, 2.0, 3.0]).where("value <> 2")
    rows = S.build_series(df, KEY, "ts", "value", how="sum").orderBy("ts").toPandas()
    assert list(rows["value"]) == [1, 0, 3]


def test_loess_parts_add_up(spark):
    parts = S.decompose_stl(frame(spark, seasonal()), KEY, 365).toPandas()
    np.testing.assert_allclose(parts["trend"] + parts["seasonal"] + parts["residual"], parts["observed"], atol=1e-8)
    strength = S.component_strength(S.decompose_stl(frame(spark, seasonal()), KEY, 365), KEY).first()
    assert strength["seasonal_strength"] > 0.9 and 15 < strength["seasonal_amplitude"] < 30


def test_short_series_are_not_decomposed(spark):
    assert S.decompose_stl(frame(spark, np.arange(20.0)), KEY, 12).count() == 0
    assert S.decompose_additive(frame(spark, np.arange(20.0)), KEY, 12).count() == 0


def test_spike_is_an_anomaly(spark):
    values = seasonal(400)
    values[200] += 40
    parts = S.decompose_additive(frame(spark, values), KEY, 7)
    days = {str(r["ts"]) for r in S.anomalies(parts, KEY, 5.0).collect()}
    assert str(pd.Timestamp("2020-01-01") + pd.Timedelta(days=200))[:10] in days


def test_white_noise_has_few_significant_lags(spark):
    noise = np.random.default_rng(0).normal(size=2000)
    acf = S.autocorrelation(frame(spark, noise), KEY, 40)
    assert S.significant_lags(acf, KEY, 40).count() <= 5
    first = acf.where("lag = 0").first()
    assert first["acf"] == 1.0 and first["high"] == 0.0


def test_partial_autocorrelation_of_an_autoregression(spark):
    rng = np.random.default_rng(0)
    x = np.zeros(2000)
    for i in range(1, 2000):
        x[i] = 0.8 * x[i - 1] + rng.normal()
    p = {r["lag"]: r["pacf"] for r in S.partial_autocorrelation(frame(spark, x), KEY, 10).collect()}
    assert abs(p[1] - 0.8) < 0.05 and all(abs(p[k]) < 0.08 for k in range(2, 11))


def test_features_do_not_look_ahead(spark):
    rows = FC.make_features(frame(spark, np.arange(100.0)), KEY, n_lags=3, windows=(5,), horizon=2).orderBy("ts").toPandas()
    v = rows["value"]
    assert (rows["lag_1"] == v - 1).all() and (rows["lag_3"] == v - 3).all()
    assert (rows["mean_5"] == v - 3).all() and (rows["target"] == v + 2).all()
    assert len(rows) == 100 - 5 - 2


def test_changing_the_future_changes_no_feature(spark):
    a, b = np.arange(60.0), np.arange(60.0)
    b[40:] = 999
    names = FC.feature_names(3, (5,))
    left = FC.make_features(frame(spark, a), KEY, 3, (5,)).where("ts < '2020-02-09'").select("ts", *names).orderBy("ts").collect()
    right = FC.make_features(frame(spark, b), KEY, 3, (5,)).where("ts < '2020-02-09'").select("ts", *names).orderBy("ts").collect()
    assert left == right


def test_training_ends_before_the_test_starts(spark):
    rows = FC.fold_ranges(FC.make_features(frame(spark, seasonal(300)), KEY), KEY, 5).collect()
    assert len(rows) == 5
    assert all(r["train_end"] < r["test_start"] for r in rows)
    assert len({r["test_rows"] for r in rows}) == 1


def test_horizon_beyond_the_period_is_refused(spark):
    with pytest.raises(ValueError):
        FC.add_baselines(frame(spark, np.arange(10.0)), KEY, horizon=8, period=7)


def test_random_walk_is_hard_to_beat_and_season_is_not(spark):
    walk = 100 + np.cumsum(np.random.default_rng(3).normal(size=1200))
    both = frame(spark, walk, "walk").unionByName(frame(spark, seasonal(), "season"))
    folds = FC.backtest_baselines(both, KEY, horizon=30, period=365)
    scores = {(r["series"], r["method"]): r["rmse"] for r in FC.fold_summary(folds, KEY).collect()}
    assert scores["season", "seasonal_naive"] < scores["season", "naive"]
    assert scores["walk", "naive"] < scores["walk", "mean"]
    features = FC.make_features(both, KEY, horizon=30)
    ridge = FC.score_predictions(FC.ridge_predictions(features, KEY, FC.feature_names()), KEY, "ridge")
    learned = {r["series"]: r["rmse"] for r in FC.fold_summary(ridge, KEY).collect()}
    assert learned["season"] < scores["season", "naive"]
