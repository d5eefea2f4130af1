"""Signals: frequencies are recovered, filters keep what they should, long series agree with short ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismill.operators import pixels as P
from prismill.operators import signals as S


def tones(spark, n=2000, rate=500):
    t = np.arange(n) / rate
    v = np.sin(2 * np.pi * 5 * t) + 0.5 * np.sin(2 * np.pi * 20 * t) + 0.25 * np.sin(2 * np.pi * 60 * t)
    return v, spark.createDataFrame(pd.DataFrame({"series": "a", "n": np.arange(n), "value": v}))


def test_three_tones(spark):
    _, df = tones(spark)
    peaks = S.spectral_peaks(S.spectrum(df, ["series"], 500), ["series"]).orderBy("rank").collect()
    assert [(round(p["frequency"]), round(p["amplitude"], 2)) for p in peaks] == [(5, 1.0), (20, 0.5), (60, 0.25)]


@pytest.mark.parametrize("n", [720, 211])
def test_long_transform_equals_fft(spark, n):
    rng = np.random.default_rng(0)
    v = rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"series": "a", "n": np.arange(n), "value": v}))
    got = S.long_transform(df, ["series"], max_group=100).orderBy("n").toPandas()
    want = np.fft.fft(v)
    assert len(got) == n
    np.testing.assert_allclose(got["re"], want.real, atol=1e-8)
    np.testing.assert_allclose(got["im"], want.imag, atol=1e-8)


@pytest.mark.parametrize("n", [600, 601, 17])
def test_spectrum_equals_fft(spark, n):
    v, df = tones(spark, n)
    got = S.spectrum(df, ["series"], 500).orderBy("bin").toPandas()
    want = np.abs(np.fft.rfft(v)) * 2 / n
    want[0] /= 2
    np.testing.assert_allclose(got["amplitude"], want, atol=1e-9)
    np.testing.assert_allclose(got["frequency"], np.fft.rfftfreq(n, 1 / 500))


def coefficients(zeros, poles, gain):
    return np.real(gain * np.poly(zeros)), np.real(np.poly(poles))


def one_pass(x, b, a, z):
    """The recursion sample by sample."""
    out, z = [], np.array(z, float)
    for v in x:
        y = b[0] * v + z[0]
        z = np.append(z[1:], 0.0) + b[1:] * v - a[1:] * y
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("kind, edges, n", [("lowpass", (10, 0), 5000), ("highpass", (40, 0), 333), ("bandpass", (15, 26), 4200), ("lowpass", (90, 0), 16)])
def test_filter_equals_the_recursion(spark, kind, edges, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n).cumsum()
    df = spark.createDataFrame(pd.DataFrame({"series": ["a"] * n, "n": np.arange(n), "value": x}))
    got = S.band_filter(df, ["series"], 500, kind, *edges).orderBy("n").toPandas()
    low, high = (edges[0] / 250, edges[1] / 250)
    design = S.butterworth(kind, low, high or low, 4)
    recursion, (b, a) = S.Recursion(*design), coefficients(*design)
    state = np.linalg.solve(np.eye(len(a) - 1) - (np.eye(len(a) - 1, k=1) - np.outer(a[1:], np.eye(len(a) - 1)[0])), b[1:] - a[1:] * b[0])
    assert recursion.order == len(a) - 1
    pad = 3 * len(a)
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    once = one_pass(long, b, a, state * long[0])[::-1]
    want = one_pass(once, b, a, state * once[0])[::-1][pad : pad + n]
    assert list(got["n"]) == list(range(n))
    np.testing.assert_allclose(got["value"], want, rtol=1e-6, atol=1e-6 * np.abs(x).max())


def test_butterworth_has_its_response():
    for kind, low, high, half_power in (("lowpass", 0.2, 0.2, (0.2,)), ("highpass", 0.3, 0.3, (0.3,)), ("bandpass", 0.1, 0.25, (0.1, 0.25))):
        b, a = coefficients(*S.butterworth(kind, low, high, 4))
        at = lambda w: abs(np.polyval(b, np.exp(1j * np.pi * w)) / np.polyval(a, np.exp(1j * np.pi * w)))
        assert all(at(w) == pytest.approx(np.sqrt(0.5), rel=1e-6) for w in half_power)
        passed = {"lowpass": 0.01, "highpass": 0.9, "bandpass": 0.16}[kind]
        assert at(passed) == pytest.approx(1, abs=2e-2) and at(0.6 if kind == "lowpass" else 0.02) < 0.02


def test_filters(spark):
    _, df = tones(spark)
    t = np.arange(2000) / 500
    low = S.band_filter(df, ["series"], 500, "lowpass", low_hz=10).orderBy("n").toPandas()["value"].to_numpy()
    inner = slice(300, 1700)
    np.testing.assert_allclose(low[inner], np.sin(2 * np.pi * 5 * t)[inner], atol=0.03)
    band = S.band_filter(df, ["series"], 500, "bandpass", low_hz=15, high_hz=26).orderBy("n").toPandas()["value"].to_numpy()
    np.testing.assert_allclose(band[inner], 0.5 * np.sin(2 * np.pi * 20 * t)[inner], atol=0.05)
    same = S.band_filter(df, ["series"], 500, "none")
    assert same is df


def test_spectrogram_shape(spark):
    _, df = tones(spark)
    out = S.spectrogram(df, ["series"], 500, 128)
    frames = out.groupBy("frame").agg(F.count("*").alias("n"), F.max_by("frequency", "decibel").alias("f")).collect()
    assert len(frames) == (2000 - 128) // 64 + 1 and {r["n"] for r in frames} == {65}
    assert all(r["f"] < 10 for r in frames)


def test_image_algebra(spark):
    image = [float((i * 37) % 11) for i in range(64)]
    df = spark.createDataFrame([(1, image), (2, [0.5] * 64)], "id int, image array<double>")
    same = df.withColumn("o", P.convolve(F.col("image"), P.KERNELS["identity"], 8, 8))
    assert same.where("o <> image").count() == 0
    flat = df.where("id = 2").select(P.convolve(F.col("image"), P.KERNELS["edge"], 8, 8).alias("o")).first()["o"]
    assert max(abs(v) for v in flat) < 1e-12
    zero = df.where("id = 2").select(P.normalise(F.col("image")).alias("o")).first()["o"]
    assert set(zero) == {0.0}
    sizes = P.image_features(df, "image", "hog").select(F.size("features")).collect()
    assert {r[0] for r in sizes} == {288}
    # a kernel is flipped: a single bright pixel spreads as the kernel itself
    dot = [0.0] * 64
    dot[3 * 8 + 3] = 1.0
    out = spark.createDataFrame([(dot,)], "image array<double>").select(P.convolve(F.col("image"), P.KERNELS["emboss"], 8, 8).alias("o")).first()["o"]
    assert [out[(2 + i) * 8 + 2 + j] for i in range(3) for j in range(3)] == [-2, -1, 0, -1, 1, 1, 0, 1, 2]
