"""Time-series queries: order values per priority on daily, weekly and monthly grids."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from prismill.functions.rounding import settled, settled_sql
from prismill.operators import forecasting, series
from prismill.plans.registry import query, table

KEY = ["series"]


def day(name: str = "ts"):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def orders(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("series"), "o_orderdate", "o_totalprice", "o_orderkey"
    )


def events(spark, folder):
    """Event values per type; the values of one type are cut out on every third day, which leaves gaps."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("series"), "ts",
        F.when((F.day("ts") % 3 != 1) | (F.col("event_type") != "view"), F.col("value")).alias("value"),
    )


def grid_sql(source: str, grain: str, how: str) -> str:
    """SQL of the regular grid over (series, t, v) rows of ``source``."""
    bins = {
        "D": "CAST(t AS DATE)",
        "W": "CAST(date_trunc('week', CAST(t AS DATE)) AS DATE) + 6",
        "ME": "last_day(CAST(t AS DATE))",
    }[grain]
    value = {
        "mean": "avg(v)", "sum": "coalesce(sum(v), 0)", "max": "max(v)", "min": "min(v)",
        "last": "arg_max(v, t) FILTER (WHERE v IS NOT NULL)",
    }[how]
    if grain == "ME":
        grid = "SELECT series, last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE)) AS ts FROM span"
    else:
        step = "1 DAY" if grain == "D" else "7 DAY"
        grid = f"SELECT series, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL {step})) AS DATE) AS ts FROM span"
    empty = "coalesce(value, 0)" if how == "sum" else "value"
    return f"""
    src AS ({source}),
    binned AS (SELECT series, {bins} AS ts, {value} AS value FROM src WHERE t IS NOT NULL GROUP BY 1, 2),
    span AS (SELECT series, min(ts) AS a, max(ts) AS b FROM binned GROUP BY series),
    points AS ({grid}),
    raw AS (SELECT points.series, points.ts, {empty} AS value FROM points LEFT JOIN binned
            ON points.series = binned.series AND points.ts = binned.ts),
    filled AS (SELECT series, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS value FROM raw),
    s AS (SELECT * FROM filled WHERE value IS NOT NULL)
    """


ORDER_ROWS = "SELECT o_orderpriority AS series, o_orderdate AS t, o_totalprice AS v FROM orders"
EVENT_ROWS = """SELECT event_type AS series, ts AS t,
    CASE WHEN extract('day' FROM ts) % 3 <> 1 OR event_type <> 'view' THEN value END AS v FROM events"""
DAILY = grid_sql(ORDER_ROWS, "D", "mean")
MONTHLY = grid_sql(ORDER_ROWS, "ME", "mean")

for _grain, _how in (("D", "mean"), ("W", "max"), ("ME", "sum")):

    @query(
        f"resample_{dict(D='daily', W='weekly', ME='monthly')[_grain]}_{_how}",
        "T01 W07",
        f"WITH {grid_sql(ORDER_ROWS, _grain, _how)} SELECT series, strftime(ts, '%Y-%m-%d') AS ts, {settled_sql('value', 2)} AS value FROM s",
    )
    def _resampled(spark, folder, grain=_grain, how=_how):
        out = series.build_series(orders(spark, folder), KEY, "o_orderdate", "o_totalprice", grain, how)
        return out.select("series", day(), settled("value", 2))


@query(
    "resample_daily_last",
    "T01",
    f"WITH {grid_sql(EVENT_ROWS, 'D', 'last')} SELECT series, strftime(ts, '%Y-%m-%d') AS ts, value FROM s",
)
def resample_daily_last(spark, folder):
    return series.build_series(events(spark, folder), KEY, "ts", "value", "D", "last").select("series", day(), "value")


@query(
    "series_gaps",
    "T02 T03",
    f"WITH {grid_sql(EVENT_ROWS, 'D', 'mean')} SELECT series, count(*) - count(value) AS gaps, count(*) AS points FROM raw GROUP BY series",
)
def series_gaps(spark, folder):
    return series.count_gaps(events(spark, folder), KEY, "ts", "value", "D", "mean")


def daily(spark, folder):
    return series.build_series(orders(spark, folder), KEY, "o_orderdate", "o_totalprice", "D", "mean")


def monthly(spark, folder):
    return series.build_series(orders(spark, folder), KEY, "o_orderdate", "o_totalprice", "ME", "mean")


@cache
def parts_sql(prefix: str, period: int) -> str:
    half = period // 2
    edge = (
        f"- 0.5 * (lag(value, {half}) OVER w + lead(value, {half}) OVER w)" if period % 2 == 0 else ""
    )
    return f"""
    {prefix},
    num AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM s),
    tr AS (SELECT *, CASE WHEN count(value) OVER c = {2 * half + 1} THEN (sum(value) OVER c {edge}) / {period} END AS trend
           FROM num WHERE n >= {2 * period}
           WINDOW c AS (PARTITION BY series ORDER BY ts ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING), w AS (PARTITION BY series ORDER BY ts)),
    se AS (SELECT series, i % {period} AS p, avg(value - trend) AS m FROM tr GROUP BY 1, 2),
    sc AS (SELECT series, p, m - avg(m) OVER (PARTITION BY series) AS seasonal FROM se),
    parts AS (SELECT tr.series, ts, value AS observed, trend, seasonal, value - trend - seasonal AS residual
              FROM tr JOIN sc ON tr.series = sc.series AND tr.i % {period} = sc.p)
    """


@query(
    "decompose_additive",
    "T04 T03",
    f"""WITH {parts_sql(MONTHLY, 12)} SELECT series, strftime(ts, '%Y-%m-%d') AS ts, {settled_sql('observed', 3)} AS observed,
    {settled_sql('trend', 3)} AS trend, {settled_sql('seasonal', 3)} AS seasonal, {settled_sql('residual', 3)} AS residual FROM parts""",
)
def decompose_additive(spark, folder):
    out = series.decompose_additive(monthly(spark, folder), KEY, series.default_period("ME"))
    return out.select("series", day(), *[settled(c, 3) for c in ("observed", "trend", "seasonal", "residual")])


@query("decompose_loess", "T04")
def decompose_loess(spark, folder):
    return series.decompose_stl(monthly(spark, folder), KEY, 12)


@query("decompose_loess_daily", "T04 T05")
def decompose_loess_daily(spark, folder):
    parts = series.decompose_stl(daily(spark, folder), KEY, series.default_period("D"))
    return series.component_strength(parts, KEY)


@query(
    "component_strength",
    "T05",
    f"""WITH {parts_sql(MONTHLY, 12)} SELECT series,
    round(CASE WHEN var_samp(residual + seasonal) > 0 THEN greatest(0, least(1, 1 - var_samp(residual) / var_samp(residual + seasonal))) ELSE 0 END, 6) AS seasonal_strength,
    round(CASE WHEN var_samp(residual + trend) > 0 THEN greatest(0, least(1, 1 - var_samp(residual) / var_samp(residual + trend))) ELSE 0 END, 6) AS trend_strength,
    round(max(seasonal) - min(seasonal), 3) AS seasonal_amplitude FROM parts GROUP BY series""",
)
def component_strength(spark, folder):
    parts = series.decompose_additive(monthly(spark, folder), KEY, 12)
    return series.component_strength(parts, KEY).select(
        "series", F.round("seasonal_strength", 6).alias("seasonal_strength"),
        F.round("trend_strength", 6).alias("trend_strength"), F.round("seasonal_amplitude", 3).alias("seasonal_amplitude"),
    )


@query(
    "residual_anomalies",
    "T06",
    f"""WITH {parts_sql(DAILY, 7)},
    c AS (SELECT series, median(residual) AS m, stddev_samp(residual) AS sd FROM parts WHERE residual IS NOT NULL GROUP BY series),
    a AS (SELECT p.*, m, sd, abs(residual - m) AS away FROM parts p JOIN c USING (series) WHERE residual IS NOT NULL),
    k AS (SELECT series, CASE WHEN median(away) > 0 THEN 1.4826 * median(away) ELSE any_value(sd) END AS scale FROM a GROUP BY series)
    SELECT a.series, strftime(ts, '%Y-%m-%d') AS ts, round(residual, 3) AS residual, round((residual - m) / scale, 4) AS score
    FROM a JOIN k ON a.series = k.series WHERE scale > 0 AND abs((residual - m) / scale) >= 3""",
)
def residual_anomalies(spark, folder):
    parts = series.decompose_additive(daily(spark, folder), KEY, 7)
    return series.anomalies(parts, KEY, 3.0).select(
        "series", day(), F.round("residual", 3).alias("residual"), F.round("score", 4).alias("score")
    )


_ACF = f"""
    WITH {DAILY},
    c AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY ts) AS i, value - avg(value) OVER (PARTITION BY series) AS c FROM s),
    n AS (SELECT series, count(*) AS n, least(60, count(*) // 2 - 1) AS k, sum(c * c) AS v FROM c GROUP BY series),
    l AS (SELECT series, n, v, unnest(generate_series(0, k)) AS lag FROM n),
    r AS (SELECT l.series, any_value(l.n) AS n, l.lag, sum(a.c * b.c) / any_value(l.v) AS acf FROM l
          JOIN c a ON a.series = l.series JOIN c b ON b.series = l.series AND b.i = a.i - l.lag GROUP BY l.series, l.lag),
    b AS (SELECT *, CASE WHEN lag = 0 THEN 0 ELSE 1.959963984540054 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END)
          OVER (PARTITION BY series ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS band FROM r)
"""


@query(
    "autocorrelation",
    "T07",
    f"{_ACF} SELECT series, n, CAST(lag AS INT) AS lag, round(acf, 6) AS acf, round(-band, 6) AS low, round(band, 6) AS high FROM b",
)
def autocorrelation(spark, folder):
    out = series.autocorrelation(daily(spark, folder), KEY, 60)
    return out.select("series", "n", "lag", *[F.round(c, 6).alias(c) for c in ("acf", "low", "high")])


@query("partial_autocorrelation", "T08")
def partial_autocorrelation(spark, folder):
    return series.partial_autocorrelation(daily(spark, folder), KEY, 60)


@query(
    "partial_autocorrelation_first",
    "T08",
    f"""{_ACF}, u AS (SELECT series, max(n) AS n, max(acf * n / (n - lag)) FILTER (WHERE lag = 1) AS a, max(acf * n / (n - lag)) FILTER (WHERE lag = 2) AS b,
      max(acf * n / (n - lag)) FILTER (WHERE lag = 3) AS c FROM r GROUP BY series),
    p AS (SELECT series, n, unnest([1, 2, 3]) AS lag, unnest([a, (b - a * a) / (1 - a * a),
      (a ** 3 - a * b * (2 - b) + c * (1 - a * a)) / (1 - b * b - 2 * a * a * (1 - b))]) AS pacf FROM u)
    SELECT series, CAST(lag AS INT) AS lag, round(pacf, 8) AS pacf, round(1.959963984540054 / sqrt(n), 8) AS high FROM p""",
)
def partial_autocorrelation_first(spark, folder):
    """The lags that have a closed form."""
    out = series.partial_autocorrelation(daily(spark, folder), KEY, 60).where("lag BETWEEN 1 AND 3")
    return out.select("series", "lag", F.round("pacf", 8).alias("pacf"), F.round("high", 8).alias("high"))


@query(
    "significant_lags",
    "T09",
    f"""{_ACF}, o AS (SELECT series, lag, row_number() OVER (PARTITION BY series ORDER BY lag) AS r FROM b WHERE lag > 0 AND (acf < -band OR acf > band))
    SELECT series, CAST(lag AS INT) AS lag FROM o WHERE r <= 5""",
)
def significant_lags(spark, folder):
    return series.significant_lags(series.autocorrelation(daily(spark, folder), KEY, 60), KEY, 5).select("series", "lag")


def _features_sql(horizon: int, calendar: bool = True) -> str:
    lags = ", ".join(f"lag(value, {k}) OVER w AS lag_{k}" for k in range(1, 8))
    rolls = ", ".join(
        f"CASE WHEN count(value) OVER p{w} = {w} THEN avg(value) OVER p{w} END AS mean_{w}, "
        f"CASE WHEN count(value) OVER p{w} = {w} THEN stddev_samp(value) OVER p{w} END AS std_{w}"
        for w in (7, 28)
    )
    frames = ", ".join(
        f"p{w} AS (PARTITION BY series ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in (7, 28)
    )
    return f"""
    feat AS (SELECT series, ts, value, {lags}, {rolls}, CAST(month(ts) AS INT) AS month, CAST((dayofweek(ts) + 6) % 7 AS INT) AS weekday,
      sin(2 * pi() * dayofyear(ts) / 365.25) AS year_sin, cos(2 * pi() * dayofyear(ts) / 365.25) AS year_cos,
      lead(value, {horizon}) OVER w AS target FROM s WINDOW w AS (PARTITION BY series ORDER BY ts), {frames}),
    ready AS (SELECT * FROM feat WHERE lag_7 IS NOT NULL AND mean_28 IS NOT NULL AND std_28 IS NOT NULL AND target IS NOT NULL)
    """


_NAMES = forecasting.feature_names()
_ROUNDED = ", ".join(c if c in ("month", "weekday") else f"{settled_sql(c, 3)} AS {c}" for c in [*_NAMES, "target"])


@query(
    "lag_features",
    "T10 J03",
    f"WITH {DAILY}, {_features_sql(7)} SELECT series, strftime(ts, '%Y-%m-%d') AS ts, {_ROUNDED} FROM ready",
)
def lag_features(spark, folder):
    out = forecasting.make_features(daily(spark, folder), KEY, horizon=7)
    return out.select(
        "series", day(), *[c if c in ("month", "weekday") else settled(c, 3) for c in [*_NAMES, "target"]]
    )


@query(
    "baseline_forecasts",
    "T11 T12 T13 J04",
    f"""WITH {DAILY} SELECT series, strftime(ts, '%Y-%m-%d') AS ts, {settled_sql('value', 3)} AS naive,
    {settled_sql('lag(value, 358) OVER w', 3)} AS seasonal_naive, {settled_sql('avg(value) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)', 3)} AS mean
    FROM s WINDOW w AS (PARTITION BY series ORDER BY ts)""",
)
def baseline_forecasts(spark, folder):
    out = forecasting.add_baselines(daily(spark, folder), KEY, horizon=7, period=365)
    return out.select("series", day(), *[settled(c, 3) for c in forecasting.BASELINES])


def _fold_sql(rows: str, keys: str) -> str:
    return f"""
    pos AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS cnt FROM {rows}),
    fold AS (SELECT *, CASE WHEN i >= cnt - 5 * (cnt // 6) THEN (i - (cnt - 5 * (cnt // 6))) // (cnt // 6) + 1 ELSE 0 END AS fold FROM pos)
    """


@query(
    "rolling_origin_folds",
    "T16",
    f"""WITH {DAILY}, {_features_sql(1)}, {_fold_sql('ready', 'series')},
    b AS (SELECT series, fold, min(ts) AS a, max(ts) AS z, count(*) AS n FROM fold GROUP BY 1, 2),
    r AS (SELECT series, fold, min(a) OVER w AS train_start, max(z) OVER w AS train_end, a AS test_start, z AS test_end,
      sum(n) OVER w AS train_rows, n AS test_rows FROM b WINDOW w AS (PARTITION BY series ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT series, CAST(fold AS INT) AS fold, strftime(train_start, '%Y-%m-%d') AS train_start, strftime(train_end, '%Y-%m-%d') AS train_end,
      strftime(test_start, '%Y-%m-%d') AS test_start, strftime(test_end, '%Y-%m-%d') AS test_end, CAST(train_rows AS BIGINT) AS train_rows, test_rows
    FROM r WHERE fold > 0""",
)
def rolling_origin_folds(spark, folder):
    features = forecasting.make_features(daily(spark, folder), KEY, horizon=1)
    out = forecasting.fold_ranges(features.select("series", "ts"), KEY, 5)
    return out.select(
        "series", "fold", *[day(c) for c in ("train_start", "train_end", "test_start", "test_end")], "train_rows", "test_rows"
    )


_SCORES = """
    CASE WHEN count(p) >= 2 AND var_pop(target) FILTER (WHERE p IS NOT NULL) > 0
      THEN 1 - avg((target - p) ** 2) / (var_pop(target) FILTER (WHERE p IS NOT NULL)) END AS r2,
    CASE WHEN count(p) >= 2 THEN sqrt(avg((target - p) ** 2)) END AS rmse, CASE WHEN count(p) >= 2 THEN avg(abs(target - p)) END AS mae
"""
_BACKTEST = f"""
    WITH {DAILY}, {_features_sql(7)},
    base AS (SELECT series, ts, value AS naive, lag(value, 358) OVER w AS seasonal_naive,
      avg(value) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS mean FROM s WINDOW w AS (PARTITION BY series ORDER BY ts)),
    {_fold_sql('ready', 'series')},
    pred AS (SELECT f.series, f.fold, f.target, unnest(['naive', 'seasonal_naive', 'mean']) AS method, unnest([naive, seasonal_naive, mean]) AS p
      FROM fold f JOIN base b ON f.series = b.series AND f.ts = b.ts WHERE f.fold > 0),
    sc AS (SELECT series, method, fold, {_SCORES} FROM pred GROUP BY 1, 2, 3)
"""


@query(
    "backtest_baselines",
    "T17 A13",
    f"{_BACKTEST} SELECT series, method, CAST(fold AS INT) AS fold, round(r2, 5) AS r2, round(rmse, 3) AS rmse, round(mae, 3) AS mae FROM sc",
)
def backtest_baselines(spark, folder):
    out = forecasting.backtest_baselines(daily(spark, folder), KEY, horizon=7, period=365)
    return out.select("series", "method", "fold", F.round("r2", 5).alias("r2"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))


@query(
    "fold_score_table",
    "T21 A13",
    f"""{_BACKTEST} SELECT series, method, round(avg(r2), 5) AS r2, round(stddev_pop(r2), 5) AS spread,
    round(avg(rmse), 3) AS rmse, round(avg(mae), 3) AS mae FROM sc GROUP BY 1, 2""",
)
def fold_score_table(spark, folder):
    folds = forecasting.backtest_baselines(daily(spark, folder), KEY, horizon=7, period=365)
    out = forecasting.fold_summary(folds, KEY)
    return out.select(
        "series", "method", F.round("r2", 5).alias("r2"), F.round("spread", 5).alias("spread"),
        F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"),
    )


def _sweep_sql() -> str:
    horizons = list(forecasting.HORIZONS)
    pairs = ", ".join(
        f"{{'horizon': {h}, 'target': lead(value, {h}) OVER w, 'sn': lag(value, {365 - h}) OVER w}}" for h in horizons
    )
    return f"""
    WITH {DAILY}, {_features_sql(1).replace('AND target IS NOT NULL', '')},
    wide AS (SELECT series, ts, value AS naive, unnest([{pairs}]) AS h FROM s WINDOW w AS (PARTITION BY series ORDER BY ts)),
    rows_ AS (SELECT wide.series, wide.ts, naive, h.horizon AS horizon, h.target AS target, h.sn AS seasonal_naive
      FROM wide JOIN ready USING (series, ts) WHERE h.target IS NOT NULL),
    {_fold_sql('rows_', 'series, horizon')},
    pred AS (SELECT series, horizon, fold, target, unnest(['naive', 'seasonal_naive']) AS method, unnest([naive, seasonal_naive]) AS p
      FROM fold WHERE fold > 0 AND cnt >= 10),
    sc AS (SELECT series, horizon, method, fold, {_SCORES} FROM pred GROUP BY 1, 2, 3, 4),
    sw AS (SELECT series, CAST(horizon AS INT) AS horizon, method, avg(r2) AS r2, avg(rmse) AS rmse, avg(mae) AS mae FROM sc GROUP BY 1, 2, 3)
    """


@query(
    "horizon_sweep",
    "T18 A10",
    f"{_sweep_sql()} SELECT series, horizon, method, round(r2, 5) AS r2, round(rmse, 3) AS rmse, round(mae, 3) AS mae FROM sw",
)
def horizon_sweep(spark, folder):
    out = forecasting.horizon_sweep(daily(spark, folder), KEY, period=365)
    return out.select("series", "horizon", "method", F.round("r2", 5).alias("r2"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))


@query(
    "best_by_horizon",
    "T19",
    f"""{_sweep_sql()} SELECT series, horizon, arg_max(method, r2) AS method, round(max(r2), 5) AS r2,
    round(max(r2) - max(r2) FILTER (WHERE method = 'naive'), 5) AS gain FROM sw WHERE r2 IS NOT NULL GROUP BY 1, 2""",
)
def best_by_horizon(spark, folder):
    out = forecasting.best_by_horizon(forecasting.horizon_sweep(daily(spark, folder), KEY, period=365), KEY)
    return out.select("series", "horizon", "method", F.round("r2", 5).alias("r2"), F.round("gain", 5).alias("gain"))


@query("horizon_sweep_learned", "T14 T18 T19")
def horizon_sweep_learned(spark, folder):
    """The ridge forecast beside the untrained ones, per horizon."""
    series = daily(spark, folder)
    both = forecasting.horizon_sweep(series, KEY, period=365).unionByName(forecasting.ridge_sweep(series, KEY))
    return both.select("series", "horizon", "method", F.round("r2", 5).alias("r2"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))


@query("horizon_sweep_boosted", "T15 T18 T19")
def horizon_sweep_boosted(spark, folder):
    """The boosted forecast beside the others, per horizon."""
    series = daily(spark, folder)
    every = forecasting.horizon_sweep(series, KEY, period=365).unionByName(forecasting.ridge_sweep(series, KEY)).unionByName(forecasting.boosted_sweep(series, KEY))
    return every.select("series", "horizon", "method", F.round("r2", 5).alias("r2"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))


@query("boosted_forecaster_importance", "T15 T20")
def boosted_forecaster_importance(spark, folder):
    features = forecasting.make_features(daily(spark, folder), KEY, horizon=7)
    return forecasting.boosted_importance(features, KEY, _NAMES)


@query(
    "ridge_of_one_feature",
    "T14 T20",
    f"""WITH {DAILY}, {_features_sql(7)}
    SELECT series, 'lag_1' AS feature, round(abs(regr_sxy(target, lag_1) / (regr_sxx(target, lag_1) + 1000000)), 8) AS importance FROM ready GROUP BY series""",
)
def ridge_of_one_feature(spark, folder):
    """One feature and a penalty that shows: the slope has a closed form."""
    features = forecasting.make_features(daily(spark, folder), KEY, horizon=7)
    out = forecasting.ridge_importance(features, KEY, ["lag_1"], alpha=1e6)
    return out.select("series", "feature", F.round("importance", 8).alias("importance"))


@query("backtest_ridge", "T14 T17")
def backtest_ridge(spark, folder):
    features = forecasting.make_features(daily(spark, folder), KEY, horizon=7)
    predictions = forecasting.ridge_predictions(features, KEY, _NAMES, 5)
    return forecasting.score_predictions(predictions, KEY, "ridge")


@query("backtest_boosted", "T15 T17")
def backtest_boosted(spark, folder):
    features = forecasting.make_features(daily(spark, folder), KEY, horizon=7)
    predictions = forecasting.boosted_predictions(features, KEY, _NAMES)
    return forecasting.score_predictions(predictions, KEY, "boosted")


@query("forecaster_importance", "T20")
def forecaster_importance(spark, folder):
    features = forecasting.make_features(daily(spark, folder), KEY, horizon=7)
    return forecasting.ridge_importance(features, KEY, _NAMES)
