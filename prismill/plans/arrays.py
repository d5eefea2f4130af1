"""Image and signal queries: embeddings as 8x8 images, hourly event means as signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from prismill.functions.rounding import settled, settled_sql
from prismill.operators import pixels as P
from prismill.operators import signals as S
from prismill.plans.registry import query, table

_IMG = "im AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), px AS (SELECT vec_id, e, i // 8 AS y, i % 8 AS x, e[i + 1] AS v FROM im, (SELECT unnest(range(64)) AS i))"


def images(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("image"), "label")


def _conv_sql(name: str, kernel) -> str:
    terms = [
        f"{float(kernel[i][j])!r}::DOUBLE * e[least(greatest(y - ({i - 1}), 0), 7) * 8 + least(greatest(x - ({j - 1}), 0), 7) + 1]"
        for i in range(3) for j in range(3) if kernel[i][j]
    ]
    return f"{' + '.join(terms)} AS {name}"


def long_pixels(df, column="image"):
    return df.select("vec_id", F.posexplode(column).alias("pos", "value"))


for _name in ("sharpen", "emboss", "gaussian"):

    @query(
        f"convolve_{_name}",
        "I01",
        f"WITH {_IMG}, c AS (SELECT vec_id, y * 8 + x AS pos, {_conv_sql('value', P.KERNELS[_name])} FROM px) SELECT vec_id, CAST(pos AS INT) AS pos, round(value, 6) AS value FROM c",
    )
    def _convolved(spark, folder, name=_name):
        out = images(spark, folder).withColumn("image", P.convolve(F.col("image"), P.KERNELS[name], 8, 8))
        return long_pixels(out).withColumn("value", F.round("value", 6))


@query(
    "normalised_images",
    "I02",
    f"WITH {_IMG} SELECT vec_id, CAST(y * 8 + x AS INT) AS pos, round((v - list_min(e)) / (list_max(e) - list_min(e)), 6) AS value FROM px",
)
def normalised_images(spark, folder):
    return long_pixels(images(spark, folder).withColumn("image", P.normalise(F.col("image")))).withColumn("value", F.round("value", 6))


@query(
    "sobel_edges",
    "I03",
    f"""WITH {_IMG}, c AS (SELECT vec_id, y * 8 + x AS pos, {_conv_sql('a', P.SOBEL_ROWS)}, {_conv_sql('b', P.SOBEL_COLUMNS)} FROM px)
    SELECT vec_id, CAST(pos AS INT) AS pos, round(sqrt((a * a + b * b) / 2), 6) AS value FROM c""",
)
def sobel_edges(spark, folder):
    out = images(spark, folder).withColumn("image", P.edges(F.col("image"), "sobel", 8, 8))
    return long_pixels(out).withColumn("value", F.round("value", 6))


@query(
    "laplace_edges",
    "I03",
    f"WITH {_IMG}, c AS (SELECT vec_id, y * 8 + x AS pos, {_conv_sql('a', P.LAPLACE)} FROM px) SELECT vec_id, CAST(pos AS INT) AS pos, round(abs(a), 6) AS value FROM c",
)
def laplace_edges(spark, folder):
    out = images(spark, folder).withColumn("image", P.edges(F.col("image"), "laplace", 8, 8))
    return long_pixels(out).withColumn("value", F.round("value", 6))


@query(
    "otsu_threshold",
    "I04",
    f"""WITH {_IMG}, b AS (SELECT vec_id, list_min(any_value(e)) AS lo, (list_max(any_value(e)) - list_min(any_value(e))) / 256 AS w FROM px GROUP BY 1),
    h AS (SELECT px.vec_id, CAST(least(255, floor((v - lo) / w)) AS INT) AS bin, any_value(lo) AS lo, any_value(w) AS w, count(*) AS n FROM px JOIN b USING (vec_id) GROUP BY 1, 2),
    c AS (SELECT *, lo + (bin + 0.5) * w AS ce FROM h),
    s AS (SELECT vec_id, bin, ce, sum(n) OVER u AS w1, sum(n * ce) OVER u AS s1, sum(n) OVER a AS wt, sum(n * ce) OVER a AS st FROM c
      WINDOW u AS (PARTITION BY vec_id ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY vec_id)),
    v AS (SELECT vec_id, bin, ce, round(w1 * (wt - w1) * (s1 / w1 - (st - s1) / (wt - w1)) ** 2, 9) AS bv FROM s WHERE wt > w1),
    t AS (SELECT vec_id, arg_min(ce, (-bv, bin)) AS threshold FROM v GROUP BY 1)
    SELECT t.vec_id, round(threshold, 6) AS threshold, CAST(count(*) FILTER (WHERE px.v > threshold) AS INT) AS bright FROM t JOIN px USING (vec_id) GROUP BY 1, threshold""",
)
def otsu_threshold(spark, folder):
    rows = images(spark, folder)
    cut = rows.join(P.otsu_thresholds(rows, "vec_id", "image"), "vec_id")
    bright = F.aggregate(P.binarise(F.col("image"), F.col("threshold")), F.lit(0.0), lambda a, v: a + v)
    return cut.select("vec_id", F.round("threshold", 6).alias("threshold"), bright.cast("int").alias("bright"))


@query(
    "mean_threshold",
    "I04",
    f"WITH {_IMG}, m AS (SELECT vec_id, avg(v) AS m FROM px GROUP BY 1) SELECT px.vec_id, round(m, 6) AS threshold, CAST(count(*) FILTER (WHERE v > m) AS INT) AS bright FROM px JOIN m USING (vec_id) GROUP BY 1, m",
)
def mean_threshold(spark, folder):
    cut = images(spark, folder).withColumn("threshold", P.mean_threshold(F.col("image")))
    bright = F.aggregate(P.binarise(F.col("image"), F.col("threshold")), F.lit(0.0), lambda a, v: a + v)
    return cut.select("vec_id", F.round("threshold", 6).alias("threshold"), bright.cast("int").alias("bright"))


@query(
    "direction_cells",
    "I05",
    f"""WITH {_IMG}, g AS (SELECT vec_id, y, x, CASE WHEN y BETWEEN 1 AND 6 THEN e[(y + 1) * 8 + x + 1] - e[(y - 1) * 8 + x + 1] ELSE 0 END AS gy,
      CASE WHEN x BETWEEN 1 AND 6 THEN e[y * 8 + x + 2] - e[y * 8 + x] ELSE 0 END AS gx FROM px),
    a AS (SELECT vec_id, y // 2 AS cy, x // 2 AS cx, sqrt(gy * gy + gx * gx) AS m, degrees(atan2(gy, gx)) AS d FROM g),
    o AS (SELECT vec_id, cy, cx, m, CAST(floor((CASE WHEN d < 0 THEN d + 180 WHEN d >= 180 THEN d - 180 ELSE d END) / 22.5) AS INT) AS o FROM a),
    c AS (SELECT vec_id, (cy * 4 + cx) * 8 + o AS pos, sum(m) / 4 AS s FROM o GROUP BY 1, 2)
    SELECT im.vec_id, CAST(i AS INT) AS pos, round(coalesce(s, 0), 6) AS value FROM im CROSS JOIN (SELECT unnest(range(128)) AS i) r LEFT JOIN c ON c.vec_id = im.vec_id AND c.pos = i""",
)
def direction_cells(spark, folder):
    out = images(spark, folder).withColumn("image", P.hog_cells(F.col("image"), 8, 8, 8, 2))
    return long_pixels(out).withColumn("value", F.round("value", 6))


@query("direction_features", "I05 I06")
def direction_features(spark, folder):
    out = P.image_features(images(spark, folder), "image", "hog")
    return out.select("vec_id", F.size("features").alias("n_features"), F.round(F.array_max("features"), 6).alias("largest"))


@query(
    "feature_sets",
    "I06",
    f"""WITH {_IMG}, c AS (SELECT vec_id, v, {_conv_sql('a', P.SOBEL_ROWS)}, {_conv_sql('b', P.SOBEL_COLUMNS)} FROM px)
    SELECT vec_id, CAST(count(*) AS INT) AS raw_size, round(sum(v), 6) AS raw_sum, CAST(count(*) AS INT) AS edges_size,
      round(sum(sqrt((a * a + b * b) / 2)), 6) AS edges_sum FROM c GROUP BY 1""",
)
def feature_sets(spark, folder):
    rows = images(spark, folder)
    for name in ("raw", "edges"):
        rows = P.image_features(rows, "image", name, out=name)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 6)
    return rows.select(
        "vec_id", *[e for c in ("raw", "edges") for e in (F.size(c).alias(f"{c}_size"), total(c).alias(f"{c}_sum"))]
    )


@query(
    "pixel_histogram",
    "I08",
    f"""WITH {_IMG}, b AS (SELECT vec_id, list_min(any_value(e)) AS lo, (list_max(any_value(e)) - list_min(any_value(e))) / 64 AS w FROM px GROUP BY 1)
    SELECT px.vec_id, CAST(least(63, floor((v - lo) / w)) AS INT) AS bin, count(*) AS n FROM px JOIN b USING (vec_id) GROUP BY 1, 2""",
)
def pixel_histogram(spark, folder):
    return P.pixel_histogram(images(spark, folder), "vec_id", "image", 64)


@query(
    "cropped_patch",
    "I09",
    f"WITH {_IMG} SELECT vec_id, CAST((y - 2) * 4 + x - 3 AS INT) AS pos, v AS value FROM px WHERE y BETWEEN 2 AND 4 AND x BETWEEN 3 AND 6",
)
def cropped_patch(spark, folder):
    return long_pixels(images(spark, folder).withColumn("image", P.crop(F.col("image"), 2, 3, 3, 4, 8)))


def hourly(spark, folder):
    """Mean event value per type and hour of the table's time span, 0 where an hour has none."""
    rows = table(spark, folder, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    means = rows.groupBy(F.col("event_type").alias("series"), hour.alias("h")).agg(F.avg("value").alias("value"))
    first, last = means.agg(F.min("h")).scalar(), means.agg(F.max("h")).scalar()
    hours = means.select("series").distinct().withColumn("_a", first).withColumn("_b", last)
    grid = hours.select("series", "_a", F.explode(F.sequence("_a", "_b")).alias("h"))
    return grid.join(means, ["series", "h"], "left").select(
        "series", (F.col("h") - F.col("_a")).cast("int").alias("n"), F.coalesce("value", F.lit(0.0)).alias("value")
    )


HOURLY = """me AS (SELECT event_type AS series, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, avg(value) AS value FROM events GROUP BY 1, 2),
    sp AS (SELECT min(h) AS a, max(h) AS b FROM me), gr AS (SELECT series, unnest(range(a, b + 1)) AS h, a FROM (SELECT DISTINCT series FROM me), sp),
    sg AS (SELECT gr.series, gr.h - a AS n, coalesce(value, 0) AS value FROM gr LEFT JOIN me ON me.series = gr.series AND me.h = gr.h)"""
SPECTRUM = f"""{HOURLY}, ln_ AS (SELECT series, count(*) AS len FROM sg GROUP BY 1),
    bi AS (SELECT series, len, unnest(range(len // 2 + 1)) AS k FROM ln_),
    sm AS (SELECT bi.series, k, any_value(len) AS len, sum(value * cos(2 * pi() * ((k * n) % len) / len)) AS re, sum(value * sin(2 * pi() * ((k * n) % len) / len)) AS im
      FROM bi JOIN sg ON sg.series = bi.series GROUP BY 1, 2),
    sx AS (SELECT series, CAST(k AS INT) AS bin, k * 24.0::DOUBLE / len AS frequency, sqrt(re * re + im * im) * (CASE WHEN k = 0 THEN 1 ELSE 2 END) / len AS amplitude FROM sm)"""


@query("amplitude_spectrum", "G01", f"WITH {SPECTRUM} SELECT series, bin, round(frequency, 6) AS frequency, {settled_sql('amplitude', 6)} AS amplitude FROM sx")
def amplitude_spectrum(spark, folder):
    out = S.spectrum(hourly(spark, folder), ["series"], 24.0)
    return out.select("series", "bin", F.round("frequency", 6).alias("frequency"), settled("amplitude", 6))


@query(
    "spectral_peaks",
    "G02",
    f"""WITH {SPECTRUM}, p AS (SELECT *, lag(amplitude) OVER w AS l, lead(amplitude) OVER w AS r FROM sx WINDOW w AS (PARTITION BY series ORDER BY bin)),
    k AS (SELECT series, bin, frequency, amplitude, row_number() OVER (PARTITION BY series ORDER BY amplitude DESC, bin) AS rank FROM p WHERE amplitude > l AND amplitude > r AND amplitude >= 0.05)
    SELECT series, CAST(rank AS INT) AS rank, bin, round(frequency, 6) AS frequency, round(amplitude, 5) AS amplitude FROM k WHERE rank <= 5""",
)
def spectral_peaks(spark, folder):
    out = S.spectral_peaks(S.spectrum(hourly(spark, folder), ["series"], 24.0), ["series"], 5, 0.05)
    return out.select("series", "rank", "bin", F.round("frequency", 6).alias("frequency"), F.round("amplitude", 5).alias("amplitude"))


@query(
    "spectrogram",
    "G03",
    f"""WITH {HOURLY}, wd AS (SELECT series, len, least(128, greatest(16, len // 4)) AS w FROM (SELECT series, count(*) AS len FROM sg GROUP BY 1)),
    fr AS (SELECT series, w, w - w // 2 AS hop, unnest(range((len - w) // (w - w // 2) + 1)) AS frame FROM wd),
    pt AS (SELECT fr.series, frame, w, hop, sg.n - frame * hop AS j, value - avg(value) OVER (PARTITION BY fr.series, frame) AS v
      FROM fr JOIN sg ON sg.series = fr.series AND sg.n >= frame * hop AND sg.n < frame * hop + w),
    tp AS (SELECT *, CASE WHEN least(j, w - j) < w / 8 THEN 0.5 * (1 + cos(pi() * (least(j, w - j) / (w / 8) - 1))) ELSE 1 END AS taper FROM pt),
    li AS (SELECT series, frame, w, hop, k, sum(v * taper * cos(2 * pi() * ((j * k) % w) / w)) AS re, sum(v * taper * sin(2 * pi() * ((j * k) % w) / w)) AS im, sum(taper) AS t
      FROM tp, range(65) AS r(k) WHERE k <= w // 2 GROUP BY ALL)
    SELECT series, frame, round((frame * hop + w / 2) / 24, 6) AS time, round(k * 24.0::DOUBLE / w, 6) AS frequency,
      round(10 * log10(greatest((re * re + im * im) / (t * t) * (CASE WHEN k = 0 OR 2 * k = w THEN 1 ELSE 2 END), 1e-12)), 4) AS decibel FROM li""",
)
def spectrogram(spark, folder):
    out = S.spectrogram(hourly(spark, folder), ["series"], 24.0, 128)
    return out.select("series", "frame", F.round("time", 6).alias("time"), F.round("frequency", 6).alias("frequency"), F.round("decibel", 4).alias("decibel"))


@query("band_filter", "G04")
def band_filter(spark, folder):
    return S.band_filter(hourly(spark, folder), ["series"], 24.0, "bandpass", low_hz=0.5, high_hz=2.0)


_ZEROS, _POLES, _GAIN = S.butterworth("lowpass", 2 / 12, 2 / 12, 4)
_B, _A = np.real(_GAIN * np.poly(_ZEROS)), np.real(np.poly(_POLES))
_EDGE = 240  # hours after which nothing is left of the ends


@query(
    "band_filter_inside",
    "G04",
    f"""WITH RECURSIVE {HOURLY},
    im AS (SELECT 0 AS m, {_B[0]!s}::DOUBLE AS y, {", ".join(f"{_B[i]!s} - ({_A[i]!s}) * {_B[0]!s}::DOUBLE AS z{i}" for i in range(1, 5))}
      UNION ALL SELECT m + 1, z1, z2 - ({_A[1]!s}) * z1, z3 - ({_A[2]!s}) * z1, z4 - ({_A[3]!s}) * z1, -({_A[4]!s}) * z1 FROM im WHERE m < 119),
    fo AS (SELECT series, n + m AS n, sum(y * value) AS value FROM sg, im GROUP BY 1, 2),
    ba AS (SELECT series, n - m AS n, sum(y * value) AS value FROM fo, im GROUP BY 1, 2),
    sz AS (SELECT series, count(*) AS len FROM sg GROUP BY 1)
    SELECT series, CAST(n AS INT) AS n, {settled_sql('value', 4)} AS value FROM ba JOIN sz USING (series) WHERE n >= {_EDGE} AND n < len - {_EDGE}""",
)
def band_filter_inside(spark, folder):
    """The low pass where the ends are not felt: there it is the response to each sample, forward and backward."""
    rows = hourly(spark, folder)
    sizes = rows.groupBy("series").agg(F.count("*").alias("len"))
    out = S.band_filter(rows, ["series"], 24.0, "lowpass", low_hz=2.0).join(sizes, "series")
    return out.where((F.col("n") >= _EDGE) & (F.col("n") < F.col("len") - _EDGE)).select("series", "n", settled("value", 4))
