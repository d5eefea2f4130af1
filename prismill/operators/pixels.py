"""Image operators on array columns: one row per image, row-major values.

Everything that stays within one image is an expression over its array, so nothing is shuffled. Gradient
directions run in numpy on whole Arrow batches of images.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 3x3 kernels, rows top to bottom.
KERNELS = {
    "identity": ((0, 0, 0), (0, 1, 0), (0, 0, 0)),
    "blur": ((1 / 9, 1 / 9, 1 / 9), (1 / 9, 1 / 9, 1 / 9), (1 / 9, 1 / 9, 1 / 9)),
    "gaussian": ((1 / 16, 2 / 16, 1 / 16), (2 / 16, 4 / 16, 2 / 16), (1 / 16, 2 / 16, 1 / 16)),
    "sharpen": ((0, -1, 0), (-1, 5, -1), (0, -1, 0)),
    "edge": ((-1, -1, -1), (-1, 8, -1), (-1, -1, -1)),
    "sobel_x": ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1)),
    "sobel_y": ((-1, -2, -1), (0, 0, 0), (1, 2, 1)),
    "emboss": ((-2, -1, 0), (-1, 1, 1), (0, 1, 2)),
}
# Derivative kernels of the edge detectors.
SOBEL_ROWS = ((1 / 4, 2 / 4, 1 / 4), (0, 0, 0), (-1 / 4, -2 / 4, -1 / 4))
SOBEL_COLUMNS = ((1 / 4, 0, -1 / 4), (2 / 4, 0, -2 / 4), (1 / 4, 0, -1 / 4))
LAPLACE = ((0, -1, 0), (-1, 4, -1), (0, -1, 0))
OTSU_BINS = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; inside a lambda it would be worked out per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(image: Column, y: Column, x: Column, height: int, width: int) -> Column:
    """Pixel at a position, the nearest edge pixel outside."""
    row = F.least(F.greatest(y, F.lit(0)), F.lit(height - 1))
    column = F.least(F.greatest(x, F.lit(0)), F.lit(width - 1))
    return F.get(image, (row * width + column).cast("int")).cast("double")


def _each_pixel(height: int, width: int, value) -> Column:
    """Array of ``value(y, x)`` over all pixels."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(height * width - 1)),
        lambda i: value(F.floor(i / F.lit(width)).cast("int"), (i % width).cast("int")),
    )


def convolve(image: Column, kernel, height: int, width: int) -> Column:
    """True convolution (the kernel is flipped) with a 3x3 kernel, edges continued by the nearest pixel."""

    def value(pixels: Column, y: Column, x: Column) -> Column:
        out = F.lit(0.0)
        for i in range(3):
            for j in range(3):
                if kernel[i][j]:
                    out = out + F.lit(float(kernel[i][j])) * _at(pixels, y - (i - 1), x - (j - 1), height, width)
        return out

    return _let(image, lambda pixels: _each_pixel(height, width, lambda y, x: value(pixels, y, x)))


def convolve_channels(image: Column, kernel, height: int, width: int) -> Column:
    """The same kernel on every channel of an array of channel arrays."""
    return F.transform(image, lambda channel: convolve(channel, kernel, height, width))


def normalise(image: Column) -> Column:
    """Stretch each image to 0..1; a constant image becomes 0."""
    facts = F.struct(image.alias("v"), F.array_min(image).alias("low"), (F.array_max(image) - F.array_min(image)).alias("span"))

    def stretched(f: Column) -> Column:
        return F.transform(f["v"], lambda v: F.when(f["span"] < 1e-12, F.lit(0.0)).otherwise((v - f["low"]) / f["span"]))

    return _let(facts, stretched)


def edges(image: Column, method: str, height: int, width: int) -> Column:
    """Sobel gradient magnitude or absolute Laplacian."""
    if method == "laplace":
        return F.transform(convolve(image, LAPLACE, height, width), lambda v: F.abs(v))
    if method == "sobel":
        down, across = convolve(image, SOBEL_ROWS, height, width), convolve(image, SOBEL_COLUMNS, height, width)
        return F.zip_with(down, across, lambda a, b: F.sqrt((a * a + b * b) / 2))
    raise ValueError(f"unknown edge method {method}")


def crop(image: Column, y: int, x: int, rows: int, columns: int, width: int) -> Column:
    """A rectangle of pixel values."""
    return F.flatten(F.array(*[F.slice(image, (y + i) * width + x + 1, columns) for i in range(rows)]))


def average_channels(image: Column) -> Column:
    """Mean over the channels of an array of channel arrays."""
    whole = F.aggregate(
        F.slice(image, F.lit(2), F.greatest(F.size(image) - 1, F.lit(0))), F.get(image, F.lit(0)),
        lambda a, b: F.zip_with(a, b, lambda p, q: p + q),
    )
    return F.transform(whole, lambda v: v / F.size(image))


def pixel_rows(df: DataFrame, image_id: str, image: str) -> DataFrame:
    return df.select(image_id, F.posexplode(image).alias("pos", "v"))


def pixel_histogram(df: DataFrame, image_id: str, image: str, bins: int = 64) -> DataFrame:
    """Equal-width counts between the darkest and the brightest pixel of each image."""
    low, high = F.array_min(image), F.array_max(image)
    rows = df.select(image_id, low.alias("_lo"), ((high - low) / bins).alias("_w"), F.explode(image).alias("_v"))
    place = F.when(F.col("_w") <= 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / F.col("_w"))))
    return rows.groupBy(image_id, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def otsu_thresholds(df: DataFrame, image_id: str, image: str) -> DataFrame:
    """Threshold per image that best separates its two pixel groups, from a histogram of 256 bins."""
    low, high = F.array_min(image), F.array_max(image)
    rows = df.select(image_id, low.alias("_lo"), high.alias("_hi"), F.explode(image).alias("_v"))
    width = (F.col("_hi") - F.col("_lo")) / OTSU_BINS
    place = F.when(width <= 0, 0).otherwise(F.least(F.lit(OTSU_BINS - 1), F.floor((F.col("_v") - F.col("_lo")) / width))).cast("int")
    bins = rows.groupBy(image_id, "_lo", "_hi", place.alias("bin")).agg(F.count("*").alias("n"))
    bins = bins.withColumn("_centre", F.col("_lo") + (F.col("bin") + 0.5) * width)
    upto = Window.partitionBy(image_id).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(image_id)
    mass = F.col("n") * F.col("_centre")
    sums = bins.select(
        image_id, "bin", "_centre", "_lo", "_hi", F.sum("n").over(upto).alias("w1"), F.sum(mass).over(upto).alias("s1"),
        F.sum("n").over(whole).alias("w"), F.sum(mass).over(whole).alias("s"),
    )
    w2 = F.col("w") - F.col("w1")
    apart = F.col("s1") / F.col("w1") - (F.col("s") - F.col("s1")) / w2
    between = F.when(w2 > 0, F.round(F.col("w1") * w2 * apart * apart, 9)).otherwise(-1.0)
    best = F.min(F.struct((-between).alias("b"), F.col("bin"), F.col("_centre").alias("t")))
    found = sums.groupBy(image_id).agg(best.alias("b"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return found.select(image_id, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("b.t")).alias("threshold"))


def mean_threshold(image: Column) -> Column:
    return F.aggregate(image, F.lit(0.0), lambda a, v: a + v) / F.size(image)


def binarise(image: Column, threshold: Column) -> Column:
    """1 above the threshold, 0 elsewhere."""
    return _let(threshold, lambda t: F.transform(image, lambda v: (v > t).cast("double")))


def _cell_strengths(images: np.ndarray, orientations: int, cell: int) -> np.ndarray:
    """Gradient strength per image, cell row, cell column and direction."""
    down, right = np.zeros_like(images), np.zeros_like(images)
    down[:, 1:-1, :] = images[:, 2:, :] - images[:, :-2, :]
    right[:, :, 1:-1] = images[:, :, 2:] - images[:, :, :-2]
    strength = np.hypot(down, right)
    direction = np.floor(np.degrees(np.arctan2(down, right)) % 180 / (180 / orientations))
    n, height, width = images.shape
    rows, columns = height // cell, width // cell
    out = np.empty((n, rows, columns, orientations))
    for o in range(orientations):
        own = np.where(direction == o, strength, 0)[:, : rows * cell, : columns * cell]
        out[..., o] = own.reshape(n, rows, cell, columns, cell).mean(axis=(2, 4))
    return out


def _block_values(cells: np.ndarray, block: int) -> np.ndarray:
    """Overlapping blocks of cells, normalised, clipped at .2 and normalised again, one row per image."""
    n, rows, columns, _ = cells.shape
    parts = []
    for r in range(rows - block + 1):
        for c in range(columns - block + 1):
            values = cells[:, r : r + block, c : c + block, :].reshape(n, -1)
            for limit in (0.2, None):
                values = values / np.sqrt((values**2).sum(axis=1, keepdims=True) + 1e-5**2)
                values = values if limit is None else np.minimum(values, limit)
            parts.append(values)
    return np.concatenate(parts, axis=1)


def _per_batch(work):
    """Apply ``work`` to the stacked images of an Arrow batch."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(images: pd.Series) -> pd.Series:
        if images.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(work(np.stack([np.asarray(v, dtype=float) for v in images]))), index=images.index)

    return run


def hog_cells(image: Column, height: int, width: int, orientations: int = 8, cell: int = 2) -> Column:
    """Gradient strength per cell and direction, in the order cell row, cell column, direction."""
    work = lambda flat: _cell_strengths(flat.reshape(-1, height, width), orientations, cell).reshape(len(flat), -1)
    return _per_batch(work)(image)


def hog(image: Column, height: int, width: int, orientations: int = 9, cell: int = 16, block: int = 2) -> Column:
    """Normalised blocks of gradient directions, the feature vector of an image."""
    work = lambda flat: _block_values(_cell_strengths(flat.reshape(-1, height, width), orientations, cell), block)
    return _per_batch(work)(image)


def image_features(df: DataFrame, image: str, method: str, height: int = 8, width: int = 8, out: str = "features") -> DataFrame:
    """Feature array per image: raw values, gradient directions or edge strength."""
    c = F.col(image)
    if method == "raw":
        return df.withColumn(out, c)
    if method == "edges":
        return df.withColumn(out, edges(c, "sobel", height, width))
    if method == "hog":
        return df.withColumn(out, hog(c, height, width, orientations=8, cell=2, block=2))
    raise ValueError(f"unknown feature set {method}")


def side(length: int) -> int:
    """Side of a square image with this many pixels."""
    return math.isqrt(length)
