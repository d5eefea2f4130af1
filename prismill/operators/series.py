"""Regular time series: resampling, decomposition, autocorrelation.

A series is rows ``(keys..., ts, value)``. Raw rows are first aggregated to the grid of the chosen
grain, so a window per key never holds more rows than the time span has grid points,
however many raw rows a key has.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Grain -> default season length in points.
PERIODS = {"D": 365, "W": 52, "ME": 12}
AGGREGATIONS = ("mean", "sum", "max", "min", "last")
# Fixed value: two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054
# Fixed value: scales a median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826


def default_period(grain: str) -> int:
    return PERIODS[grain]


def by_time(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("ts")


def moving_averages(series: DataFrame, keys: list[str], windows: tuple[int, ...]) -> DataFrame:
    """Add ``ma_w`` per window, null until the window is full; windows under 2 or not shorter than the series stay out."""
    out = series
    n = F.count("value").over(Window.partitionBy(*keys))
    for w in windows:
        if w < 2:
            continue
        frame = by_time(keys).rowsBetween(-(w - 1), 0)
        full = (F.count("value").over(frame) == w) & (n > w)
        out = out.withColumn(f"ma_{w}", F.when(full, F.avg("value").over(frame)))
    return out


def fill_forward(series: DataFrame, keys: list[str]) -> DataFrame:
    """Fill holes with the last value before them; leading holes go."""
    frame = by_time(keys).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last("value", ignorenulls=True).over(frame)
    return series.withColumn("value", filled).where("value IS NOT NULL")


def _bin(time: Column, grain: str) -> Column:
    day = time.cast("date")
    if grain == "D":
        return day
    if grain == "W":
        return F.next_day(F.date_sub(day, 1), "SU")
    if grain == "ME":
        return F.last_day(day)
    raise ValueError(f"unknown grain {grain}")


def _aggregate(how: str) -> Column:
    value = F.col("_v")
    known = F.when(value.isNotNull(), F.struct("_t", "_v"))
    return {
        "mean": lambda: F.avg(value),
        "sum": lambda: F.coalesce(F.sum(value), F.lit(0.0)),
        "max": lambda: F.max(value),
        "min": lambda: F.min(value),
        "last": lambda: F.max(known).getField("_v"),
    }[how]()


def regular_grid(
    df: DataFrame, keys: list[str], time: str, value: str, grain: str = "D", how: str = "mean"
) -> DataFrame:
    """Aggregate to one row per grid point and key; points without data are null (0 for sums)."""
    number = F.col(value).try_cast("double") if isinstance(df.schema[value].dataType, T.StringType) else F.col(value).cast("double")
    rows = df.where(F.col(time).isNotNull()).select(
        *keys, F.col(time).alias("_t"), F.nanvl(number, F.lit(None)).alias("_v"), _bin(F.col(time), grain).alias("ts")
    )
    binned = rows.groupBy(*keys, "ts").agg(_aggregate(how).alias("value"))
    span = binned.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    if grain == "ME":
        months = F.sequence(F.trunc("_a", "month"), F.trunc("_b", "month"), F.expr("interval 1 month"))
        points = F.transform(months, lambda m: F.last_day(m))
    else:
        step = F.expr("interval 1 day" if grain == "D" else "interval 7 days")
        points = F.sequence("_a", "_b", step)
    grid = span.select(*keys, F.explode(points).alias("ts"))
    out = grid.join(binned, [*keys, "ts"], "left")
    return out.withColumn("value", F.coalesce("value", F.lit(0.0))) if how == "sum" else out


def build_series(
    df: DataFrame, keys: list[str], time: str, value: str, grain: str = "D", how: str = "mean"
) -> DataFrame:
    """Regular series without holes: grid, then forward fill."""
    return fill_forward(regular_grid(df, keys, time, value, grain, how), keys)


def count_gaps(
    df: DataFrame, keys: list[str], time: str, value: str, grain: str = "D", how: str = "mean"
) -> DataFrame:
    """Grid points per key that had no data."""
    grid = regular_grid(df, keys, time, value, grain, how)
    return grid.groupBy(*keys).agg(F.count_if(F.col("value").isNull()).alias("gaps"), F.count("*").alias("points"))


# --- decomposition ------------------------------------------------------------


def decompose_additive(series: DataFrame, keys: list[str], period: int) -> DataFrame:
    """Classical additive decomposition: centred moving average, then mean per season position.

    Series shorter than two periods are left out. Trend and residual are null at the two ends.
    """
    w = by_time(keys)
    half = period // 2
    numbered = series.withColumn("_i", F.row_number().over(w) - 1).withColumn(
        "_n", F.count("*").over(Window.partitionBy(*keys))
    ).where(F.col("_n") >= 2 * period)
    around = w.rowsBetween(-half, half)
    total = F.sum("value").over(around)
    if period % 2 == 0:
        total = total - 0.5 * (F.lag("value", half).over(w) + F.lead("value", half).over(w))
    full = F.count("value").over(around) == 2 * half + 1
    trended = numbered.withColumn("trend", F.when(full, total / period))
    detrended = trended.withColumn("_d", F.col("value") - F.col("trend")).withColumn("_p", F.col("_i") % period)
    season = Window.partitionBy(*keys, "_p")
    means = detrended.withColumn("_s", F.avg("_d").over(season))
    centre = F.avg(F.when(F.col("_i") < period, F.col("_s"))).over(Window.partitionBy(*keys))
    return means.withColumn("seasonal", F.col("_s") - centre).select(
        *keys, "ts", F.col("value").alias("observed"), "trend", "seasonal",
        (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"),
    )


def _line_smoother(n: int, span: int, at: np.ndarray):
    """Locally linear smoothing with tricube weights: kernels are laid out once and reused every pass."""
    q = min(span, n)
    first = np.clip(np.round(at).astype(int) - (q - 1) // 2, 0, n - q)
    index = first[:, None] + np.arange(q)[None, :]
    offset = index - at[:, None]
    reach = np.abs(offset[:, [0, -1]]).max(axis=1) + max(span - n, 0) / 2
    distance = np.abs(offset) / np.maximum(reach, 1)[:, None]
    kernel = np.where(distance < 0.999, (1 - np.minimum(distance, 1) ** 3) ** 3, 0.0)
    kernel[distance < 0.001] = 1.0
    moments = [kernel, kernel * offset, kernel * offset**2]

    def total(moment: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.einsum("...ij,ij->...i", values, moment)

    def smooth(y: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
        """Fit each row of ``y``."""
        if weights is None:
            mass, first_moment, second_moment = (m.sum(axis=1) for m in moments)
            values = y[..., index]
        else:
            local = weights[..., index]
            mass, first_moment, second_moment = (total(m, local) for m in moments)
            values = local * y[..., index]
        mass = np.where(mass > 0, mass, 1)
        level, slope = total(moments[0], values) / mass, total(moments[1], values) / mass
        centre = first_moment / mass
        spread = np.maximum(second_moment / mass - centre**2, 0)
        tilted = np.sqrt(spread) > 0.001 * max(n - 1, 1)
        return level - np.where(tilted, centre * (slope - centre * level) / np.where(spread > 0, spread, 1), 0.0)

    return smooth


def _moving_mean(y: np.ndarray, width: int) -> np.ndarray:
    total = np.cumsum(np.concatenate([[0.0], y]))
    return (total[width:] - total[:-width]) / width


def _odd(value: float) -> int:
    number = int(np.ceil(value))
    return number + 1 if number % 2 == 0 else number


def stl(y: np.ndarray, period: int, robust: bool = True, seasonal_span: int = 7) -> tuple[np.ndarray, ...]:
    """Season and trend by loess (Cleveland et al. 1990) for one regular series."""
    n = len(y)
    trend_span = _odd(1.5 * period / (1 - 1.5 / seasonal_span))
    low_span = _odd(period + 1)
    inner, outer = (2, 15) if robust else (5, 0)
    trend, weights = np.zeros(n), None
    everywhere = np.arange(n, dtype=float)
    long = n % period
    groups = [(np.arange(long), n // period + 1)] if long else []
    groups.append((np.arange(long, period), n // period))
    seasons = [
        (
            phases[:, None] + period * np.arange(points)[None, :],
            phases[:, None] + period * np.arange(points + 2)[None, :],
            _line_smoother(points, seasonal_span, np.arange(-1, points + 1, dtype=float)),
        )
        for phases, points in groups
    ]
    smooth_low = _line_smoother(n, low_span, everywhere)
    smooth_trend = _line_smoother(n, trend_span, everywhere)
    for turn in range(outer + 1):
        for _ in range(inner):
            cycle = np.empty(n + 2 * period)
            for rows, spread_rows, smooth in seasons:
                cycle[spread_rows] = smooth((y - trend)[rows], None if weights is None else weights[rows])
            low = _moving_mean(_moving_mean(_moving_mean(cycle, period), period), 3)
            seasonal = cycle[period : period + n] - smooth_low(low, None)
            trend = smooth_trend(y - seasonal, weights)
        if turn == outer:
            break
        left = np.abs(y - trend - seasonal)
        reach = 6 * np.median(left)
        ratio = left / reach if reach > 0 else np.zeros(n)
        weights = np.where(ratio <= 0.001, 1.0, np.where(ratio <= 0.999, (1 - np.minimum(ratio, 1) ** 2) ** 2, 0.0))
    return trend, seasonal, y - trend - seasonal


def decompose_stl(series: DataFrame, keys: list[str], period: int, robust: bool = True) -> DataFrame:
    """Season, trend and residual by loess, one grouped map per series of grid points."""
    fields = [series.schema[k] for k in keys]
    out = T.StructType(
        fields + [T.StructField("ts", series.schema["ts"].dataType)]
        + [T.StructField(c, T.DoubleType()) for c in ("observed", "trend", "seasonal", "residual")]
    )

    def split(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts")
        y = part["value"].to_numpy(dtype=float)
        if len(y) < 2 * period:
            return part[[*keys, "ts"]].iloc[:0].assign(observed=0.0, trend=0.0, seasonal=0.0, residual=0.0)
        trend, seasonal, residual = stl(y, period, robust)
        return part[[*keys, "ts"]].assign(observed=y, trend=trend, seasonal=seasonal, residual=residual)

    grouping = series.groupBy(*keys) if keys else series.groupBy(F.lit(0))
    return grouping.applyInPandas(split, out)


def component_strength(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Season and trend strength between 0 and 1 and the season's amplitude."""

    def strength(name: str) -> Column:
        both = F.var_samp(F.col("residual") + F.col(name))
        share = 1 - F.var_samp("residual") / F.when(both > 0, both)
        return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), F.lit(0.0))

    return parts.groupBy(*keys).agg(
        strength("seasonal").alias("seasonal_strength"),
        strength("trend").alias("trend_strength"),
        (F.max("seasonal") - F.min("seasonal")).alias("seasonal_amplitude"),
    )


def anomalies(parts: DataFrame, keys: list[str], threshold: float = 3.0) -> DataFrame:
    """Points whose residual lies ``threshold`` robust deviations from the median.

    The medians run over grid points of one series, not over raw rows.
    """
    known = parts.where(F.col("residual").isNotNull())
    centre = known.groupBy(*keys).agg(F.median("residual").alias("_m"), F.stddev_samp("residual").alias("_sd"))
    centred = known.join(centre, keys).withColumn("_a", F.abs(F.col("residual") - F.col("_m")))
    spread = centred.groupBy(*keys).agg(F.median("_a").alias("_mad"))
    scored = centred.join(spread, keys)
    scale = F.when(F.col("_mad") > 0, F.col("_mad") * MAD_SCALE).otherwise(F.col("_sd"))
    score = (F.col("residual") - F.col("_m")) / F.when(scale > 0, scale)
    return (
        scored.withColumn("score", score).where(F.abs("score") >= threshold).select(*keys, "ts", "residual", "score")
    )


# --- autocorrelation -----------------------------------------------------------


def _lag_products(series: DataFrame, keys: list[str], n_lags: int) -> DataFrame:
    """One row per key: length and the array of lagged products, by one window and one aggregate."""
    whole = Window.partitionBy(*keys)
    centred = series.select(*keys, "ts", (F.col("value") - F.avg("value").over(whole)).alias("_c"))
    w = by_time(keys)
    lagged = centred.select(
        *keys, "_c", *[(F.col("_c") * F.lag("_c", k).over(w)).alias(f"_p{k}") for k in range(1, n_lags + 1)]
    )
    products = F.array(F.sum(F.col("_c") * F.col("_c")), *[F.sum(f"_p{k}") for k in range(1, n_lags + 1)])
    limit = F.least(F.lit(n_lags), F.floor(F.col("n") / 2) - 1).cast("int")
    rows = lagged.groupBy(*keys).agg(F.count("*").alias("n"), products.alias("_products"))
    return rows.withColumn("_limit", limit).where("_limit >= 1").withColumn(
        "_products", F.slice("_products", F.lit(1), F.col("_limit") + 1)
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _partial(rows: pd.Series, lengths: pd.Series) -> pd.Series:
    """Partial autocorrelations from lagged products by the Durbin-Levinson recursion."""

    def one(products, n: int) -> list[float]:
        gamma = np.asarray(products, dtype=float) / (n - np.arange(len(products)))
        if gamma[0] == 0:
            return [1.0] + [float("nan")] * (len(gamma) - 1)
        rho = gamma / gamma[0]
        out, phi, error = [1.0], np.zeros(0), 1.0
        for k in range(1, len(rho)):
            reflect = (rho[k] - phi @ rho[k - 1 : 0 : -1]) / error
            phi = np.concatenate([phi - reflect * phi[::-1], [reflect]])
            error *= 1 - reflect**2
            out.append(float(reflect))
        return out

    return pd.Series([one(p, int(n)) for p, n in zip(rows, lengths)])


def autocorrelation(series: DataFrame, keys: list[str], n_lags: int = 60) -> DataFrame:
    """Autocorrelation per lag with the band an uncorrelated series would stay in."""
    long = _lag_products(series, keys, n_lags).select(
        *keys, "n", F.posexplode(F.transform("_products", lambda p: p / F.col("_products")[0])).alias("lag", "acf")
    )
    earlier = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    squares = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") ** 2)).over(earlier), F.lit(0.0))
    half = F.when(F.col("lag") == 0, 0.0).otherwise(Z95 * F.sqrt((1 + 2 * squares) / F.col("n")))
    return long.withColumn("band", half).select(*keys, "n", "lag", "acf", (-F.col("band")).alias("low"), F.col("band").alias("high"))


def partial_autocorrelation(series: DataFrame, keys: list[str], n_lags: int = 60) -> DataFrame:
    """Partial autocorrelation per lag with its band."""
    rows = _lag_products(series, keys, n_lags).withColumn("_partial", _partial("_products", "n"))
    long = rows.select(*keys, "n", F.posexplode("_partial").alias("lag", "pacf"))
    half = F.when(F.col("lag") == 0, 0.0).otherwise(Z95 / F.sqrt("n"))
    return long.withColumn("high", half).withColumn("low", -F.col("high"))


def significant_lags(acf: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """The first lags outside the band."""
    outside = acf.where((F.col("lag") > 0) & ((F.col("acf") < F.col("low")) | (F.col("acf") > F.col("high"))))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("lag"))
    return outside.withColumn("_r", place).where(F.col("_r") <= top).drop("_r")
