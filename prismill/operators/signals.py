"""Signal operators: rows ``(keys..., n, value)`` with n = 0, 1, 2, ... and a sample rate.

Transforms are sums of products in plain columns: short groups of samples meet the turns of their frequencies. A long series is
split into many short groups in two rounds, so its work grows with n * sqrt(n) and no task holds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismill.session import cut_lineage

FLOOR = 1e-12
#: longest group whose sums are formed directly; lengths that leave longer ones go through a convolution
MAX_GROUP = 2048


def spectrum(df: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """Amplitude of every frequency up to half the rate, on the scale of the sine waves in the signal."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    turned = long_transform(df, keys).join(sizes, keys).where(F.col("n") <= F.floor(F.col("_n") / 2))
    size = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) * 2 / F.col("_n")
    return turned.select(
        *keys, F.col("n").cast("int").alias("bin"), (F.col("n") * F.lit(float(rate)) / F.col("_n")).alias("frequency"),
        F.when(F.col("n") == 0, size / 2).otherwise(size).alias("amplitude"),
    )


def spectral_peaks(lines: DataFrame, keys: list[str], top: int = 5, min_amplitude: float = 0.05) -> DataFrame:
    """Strongest local maxima of each spectrum; the middle of a flat top counts once."""
    w = Window.partitionBy(*keys).orderBy("bin")
    # equal neighbours form one plateau
    step = lines.withColumn("_new", (F.col("amplitude") != F.lag("amplitude").over(w)).cast("int"))
    groups = step.withColumn("_g", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flats = groups.groupBy(*keys, "_g").agg(
        F.min("bin").alias("_a"), F.max("bin").alias("_b"), F.max("amplitude").alias("amplitude")
    )
    v = Window.partitionBy(*keys).orderBy("_a")
    peaks = flats.withColumn("_l", F.lag("amplitude").over(v)).withColumn("_r", F.lead("amplitude").over(v)).where(
        (F.col("amplitude") > F.col("_l")) & (F.col("amplitude") > F.col("_r")) & (F.col("amplitude") >= min_amplitude)
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("amplitude"), "_a"))
    best = peaks.withColumn("rank", place).where(F.col("rank") <= top)
    middle = F.floor((F.col("_a") + F.col("_b")) / 2).cast("int")
    frequencies = lines.select(*keys, F.col("bin"), "frequency")
    return best.withColumn("bin", middle).select(*keys, "rank", "bin", "amplitude").join(frequencies, [*keys, "bin"])


def spectrogram(df: DataFrame, keys: list[str], rate: float, window: int = 128) -> DataFrame:
    """Power in decibels per half-overlapping frame and frequency.

    A sample belongs to at most two frames, so a frame is a group of ``window`` rows whatever the
    series' length; its frequencies are sums over these rows. The taper is a Tukey window of shape 1/4, frames are
    centred on their mean.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    width = F.least(F.lit(window), F.greatest(F.lit(16), F.floor(F.col("_size") / 4))).cast("int")
    rows = df.join(sizes.withColumn("_w", width), keys)
    hop = F.col("_w") - F.floor(F.col("_w") / 2)
    last = F.floor((F.col("_size") - F.col("_w")) / hop)
    high = F.floor(F.col("n") / hop)
    low = F.greatest(F.lit(0), F.ceil((F.col("n") - F.col("_w") + 1) / hop))
    framed = rows.withColumn("frame", F.explode(F.when(low <= F.least(high, last), F.sequence(low, F.least(high, last)))))
    framed = framed.withColumns({"_j": F.col("n") - F.col("frame") * hop, "value": F.col("value").cast("double")})
    group = [*keys, "frame"]
    tapered = framed.withColumn("_taper", _tukey(F.col("_j"), F.col("_w")))
    centred = tapered.withColumn("_x", (F.col("value") - F.avg("value").over(Window.partitionBy(*group))) * F.col("_taper"))
    met = centred.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_w") / 2))))
    angle = F.lit(2 * math.pi) * (F.col("_j") * F.col("_k") % F.col("_w")) / F.col("_w")
    lines = met.groupBy(*group, "_w", "_k").agg(
        F.sum(F.col("_x") * F.cos(angle)).alias("_re"), F.sum(F.col("_x") * F.sin(angle)).alias("_im"), F.sum("_taper").alias("_t")
    )
    power = (F.col("_re") ** 2 + F.col("_im") ** 2) / F.col("_t") ** 2
    once = (F.col("_k") == 0) | (2 * F.col("_k") == F.col("_w"))
    return lines.select(
        *group, ((F.col("frame") * hop + F.col("_w") / 2) / F.lit(float(rate))).alias("time"),
        (F.col("_k") * F.lit(float(rate)) / F.col("_w")).alias("frequency"),
        (10 * F.log10(F.greatest(F.when(once, power).otherwise(2 * power), F.lit(FLOOR)))).alias("decibel"),
    )


def _tukey(place: Column, width: Column, shape: float = 0.25) -> Column:
    """A window of ``width`` + 1 points without the last one, as spectral estimates use."""
    edge = F.lit(shape) * width / 2
    near = F.least(place, width - place)
    return F.when(near < edge, 0.5 * (1 + F.cos(F.pi() * (near / edge - 1)))).otherwise(F.lit(1.0))


# --- recursive filters ---------------------------------------------------------------

_CHUNK, _BLOCK = 32, 64  # samples a chunk, chunks a block


def butterworth(kind: str, low: float, high: float, order: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of a digital Butterworth filter; edges are shares of half the rate."""
    angles = np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)
    poles = np.exp(1j * angles)
    edges = 4 * np.tan(np.pi * np.array([low, high]) / 2)  # bilinear map at a rate of 2
    if kind == "lowpass":
        zeros, poles, gain = np.zeros(0), poles * edges[0], edges[0] ** order
    elif kind == "highpass":
        zeros, poles, gain = np.zeros(order), edges[0] / poles, 1.0
    else:
        centre, width = np.sqrt(edges[0] * edges[1]), edges[1] - edges[0]
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        zeros, poles, gain = np.zeros(order), np.concatenate([half + root, half - root]), width**order
    back = np.concatenate([(4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))])
    gain *= float(np.real(np.prod(4 - zeros) / np.prod(4 - poles)))
    return back, (4 + poles) / (4 - poles), gain


class Recursion:
    """A filter as an affine map of its delays: z' = A z + B x, y = d x + C z, and powers of it over runs of samples.

    Each pair of poles turns and shrinks two delays of its own, so high powers stay exact where those of one long recursion would not.
    """

    def __init__(self, zeros: np.ndarray, poles: np.ndarray, gain: float):
        self.order, self.direct = len(poles), gain
        places, rows, enter, leave = 0, [], [], []
        for k, pole in enumerate(poles):
            if pole.imag < -1e-14:
                continue  # goes with its mirror image
            residue = gain * np.prod(pole - zeros) / np.prod(pole - np.delete(poles, k))
            single = abs(pole.imag) <= 1e-14
            rows.append((places, np.array([[pole.real]]) if single else np.array([[pole.real, -pole.imag], [pole.imag, pole.real]])))
            enter += [1.0] if single else [1.0, 0.0]
            leave += [residue.real] if single else [2 * residue.real, -2 * residue.imag]
            places = len(enter)
        self.step = np.zeros((places, places))
        for at, part in rows:
            self.step[at : at + len(part), at : at + len(part)] = part
        self.input, output = np.array(enter), np.array(leave)
        powers = [np.eye(places)]
        for _ in range(_CHUNK):
            powers.append(self.step @ powers[-1])
        self.chunk = powers[_CHUNK]  # what a chunk does to the delays before it
        self.block = np.linalg.matrix_power(self.chunk, _BLOCK)
        self.into = np.array([powers[_CHUNK - 1 - j] @ self.input for j in range(_CHUNK)])  # what sample j leaves at the chunk's end
        self.out = np.array([output @ powers[j] for j in range(_CHUNK)])  # what delays at the chunk's start give at sample j
        self.response = np.array([gain, *(output @ powers[m - 1] @ self.input for m in range(1, _CHUNK))])
        self.steady = np.linalg.solve(np.eye(places) - self.step, self.input)  # delays of a constant 1


def _numbers(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _product(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _moved(state: Column, matrix: np.ndarray, added: Column) -> Column:
    return F.array(*[sum((F.lit(float(c)) * F.get(state, F.lit(k)) for k, c in enumerate(row) if c), F.get(added, F.lit(i))) for i, row in enumerate(matrix)])


def recursive_filter(df: DataFrame, keys: list[str], recursion: Recursion) -> DataFrame:
    """One pass over ``n, value`` in order of n, with delays that have seen the first value forever.

    Affine maps compose, so the recursion is a scan: every chunk of samples is summed up as what it leaves in the delays, chunks
    as blocks; blocks hand their delays on, a row of a few numbers per two thousand samples; then all chunks go on by themselves.
    """
    group = [*keys, "chunk"]
    placed = df.select(*keys, F.col("n").cast("bigint").alias("n"), F.col("value").cast("double").alias("value"))
    placed = placed.withColumns({"chunk": F.floor(F.col("n") / _CHUNK), "j": F.col("n") % _CHUNK})
    ordered = lambda name: F.sort_array(F.collect_list(F.struct("j", name)))
    chunks = placed.groupBy(*group).agg(F.transform(ordered("value"), lambda p: p["value"]).alias("x"))
    left = [_product(F.col("x"), _numbers(recursion.into[:, i])) for i in range(recursion.order)]
    chunks = cut_lineage(chunks.withColumn("left", F.when(F.size("x") == _CHUNK, F.array(*left)).otherwise(_numbers(np.zeros(recursion.order)))))

    nothing = _numbers(np.zeros(recursion.order))
    within = chunks.select(*keys, F.floor(F.col("chunk") / _BLOCK).alias("block"), (F.col("chunk") % _BLOCK).alias("j"), "left", F.when(F.col("chunk") == 0, F.get("x", F.lit(0))).alias("first"))
    blocks = within.groupBy(*keys, "block").agg(F.transform(ordered("left"), lambda p: p["left"]).alias("parts"), F.max("first").alias("first"))
    move = lambda z, w: _moved(z, recursion.chunk, w)
    blocks = cut_lineage(blocks.withColumn("left", F.aggregate("parts", nothing, move)))
    entered = _handed_on(blocks.select(*keys, "block", "left", "first"), keys, recursion)
    starts = blocks.join(entered, [*keys, "block"]).select(
        *keys, "block",
        F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.aggregate(F.slice("parts", F.lit(1), i - 1), F.col("entered"), move))).alias("j", "z"),
    )
    starts = starts.select(*keys, (F.col("block") * _BLOCK + F.col("j")).alias("chunk"), "z")
    response = _numbers(recursion.response[::-1])
    outs = F.array(*[_numbers(row) for row in recursion.out])
    heard = lambda j: _product(F.slice("x", F.lit(1), j + 1), F.slice(response, _CHUNK - j, j + 1))
    y = F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda j: heard(j) + _product(F.get(outs, j), F.col("z")))
    joined = chunks.join(starts, group)
    return joined.select(*keys, "chunk", F.posexplode(y).alias("j", "value")).select(*keys, (F.col("chunk") * _CHUNK + F.col("j")).alias("n"), "value")


def _handed_on(blocks: DataFrame, keys: list[str], recursion: Recursion) -> DataFrame:
    """The delays with which each block starts, carried from block to block of a series."""
    step, steady = recursion.block, recursion.steady

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, state = None, None
        for batch in batches:
            entered = []
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            for name, left, first in zip(names, batch.column("left").to_pylist(), batch.column("first").to_pylist(), strict=True):
                if state is None or name != series:
                    series, state = name, steady * first
                entered.append(state.tolist())
                state = step @ state + left
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*keys, "block")], pa.array(entered, pa.list_(pa.float64()))], names=[*keys, "block", "entered"])

    kinds = ", ".join(f"`{c}` {dict(blocks.dtypes)[c]}" for c in (*keys, "block"))
    ordered = blocks.repartition(*keys).sortWithinPartitions(*keys, "block")
    return ordered.mapInArrow(run, f"{kinds}, entered array<double>")


def band_filter(
    df: DataFrame, keys: list[str], rate: float, kind: str, low_hz: float = 10.0, high_hz: float = 50.0, order: int = 4,
) -> DataFrame:
    """Zero-phase Butterworth low, high or band pass: the recursion forward, then backward.

    Both ends are continued by their mirror image turned upside down, for three times the filter's length.
    Series that are not longer than that are left out.
    """
    if kind == "none":
        return df
    if kind not in ("lowpass", "highpass", "bandpass"):
        raise ValueError(f"unknown filter {kind}")
    half = rate / 2
    low, high = low_hz / half, high_hz / half
    if kind == "bandpass":
        low = float(np.clip(min(low_hz, high_hz) / half, 1e-4, 0.998))
        high = float(np.clip(max(low_hz, high_hz) / half, low + 1e-4, 0.999))
    else:
        low = high = float(np.clip(low, 1e-4, 0.999))
    recursion = Recursion(*butterworth(kind, low, high, order))
    pad = 3 * (recursion.order + 1)
    plain = df.select(*keys, F.col("n").cast("bigint").alias("n"), F.col("value").cast("double").alias("value"))
    ends = plain.groupBy(*keys).agg(F.count("*").alias("_size"), F.min_by("value", "n").alias("_a"), F.max_by("value", "n").alias("_z")).where(F.col("_size") > pad)
    sized = plain.join(ends, keys)
    last = F.col("_size") - 1
    own = F.struct((F.col("n") + pad).alias("n"), F.col("value").alias("value"))
    before = F.struct((pad - F.col("n")).alias("n"), (2 * F.col("_a") - F.col("value")).alias("value"))
    after = F.struct((2 * last - F.col("n") + pad).alias("n"), (2 * F.col("_z") - F.col("value")).alias("value"))
    places = F.array_compact(F.array(
        own, F.when((F.col("n") >= 1) & (F.col("n") <= pad), before), F.when((F.col("n") < last) & (F.col("n") >= last - pad), after),
    ))
    total = F.col("_size") + 2 * pad
    ahead = recursive_filter(sized.select(*keys, F.inline(places)), keys, recursion).join(ends, keys)
    turned = recursive_filter(ahead.select(*keys, (total - 1 - F.col("n")).alias("n"), "value"), keys, recursion).join(ends, keys)
    place = total - 1 - F.col("n") - pad
    return turned.select(*keys, place.cast("int").alias("n"), "value", "_size").where((F.col("n") >= 0) & (F.col("n") < F.col("_size"))).drop("_size")


# --- transforms ----------------------------------------------------------------------


def _split(n: int) -> int:
    """Largest divisor of n not above its root."""
    return next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)


def _short_transforms(df: DataFrame, keys: list[str], group: str, place: str, length: str, sign: int) -> DataFrame:
    """Transform each short group of ``length`` rows; its output position is ``_k``.

    Rows are dealt by group first, so that the products of a group are summed where they are made.
    """
    dealt = df.repartition(*keys, group)
    met = dealt.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(length) - 1)))
    angle = F.lit(sign * 2 * math.pi) * (F.col(place) * F.col("_k") % F.col(length)) / F.col(length)
    re, im = _turned(F.col("re"), F.col("im"), angle)
    return met.groupBy(*keys, group, "_size", "_a", "_k").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def _turned(re: Column, im: Column, angle: Column) -> tuple[Column, Column]:
    c, s = F.cos(angle), F.sin(angle)
    return re * c - im * s, re * s + im * c


def _composite_transform(df: DataFrame, keys: list[str], sign: int) -> DataFrame:
    """Transform of n = a * b points as b transforms of a points, a twist, and a transforms of b points."""
    divisor = F.udf(_split, T.LongType())
    sizes = df.groupBy(*keys).agg(F.count("*").cast("bigint").alias("_size")).withColumn("_a", divisor("_size"))
    b = F.floor(F.col("_size") / F.col("_a"))
    rows = df.join(sizes, keys).withColumns({"_col": F.col("n") % b, "_row": F.floor(F.col("n") / b)})
    first = _short_transforms(rows.select(*keys, "_col", "_row", "_size", "_a", "re", "im"), keys, "_col", "_row", "_a", sign)
    angle = F.lit(sign * 2 * math.pi) * (F.col("_col") * F.col("_k") % F.col("_size")) / F.col("_size")
    re, im = _turned(F.col("re"), F.col("im"), angle)
    twisted = first.select(*keys, F.col("_k").alias("_row"), "_col", "_size", "_a", b.alias("_b"), re.alias("re"), im.alias("im"))
    second = _short_transforms(twisted, keys, "_row", "_col", "_b", sign)
    return second.select(*keys, (F.col("_row") + F.col("_a") * F.col("_k")).alias("n"), "re", "im")


def long_transform(df: DataFrame, keys: list[str], inverse: bool = False, max_group: int = MAX_GROUP) -> DataFrame:
    """Discrete Fourier transform of any length without gathering a series.

    ``df`` has ``n`` and ``value`` or ``re, im``. Lengths with a divisor near their root take two
    rounds of short transforms. Other lengths (large primes) become a circular convolution of
    power-of-two length, which always splits evenly.
    """
    sign = 1 if inverse else -1
    if "re" not in df.columns:
        df = df.withColumns({"re": F.col("value").cast("double"), "im": F.lit(0.0)})
    df = df.select(*keys, F.col("n").cast("bigint").alias("n"), "re", "im")
    lengths = df.groupBy(*keys).agg(F.count("*").cast("bigint").alias("_len"))
    longest = F.udf(lambda n: n // _split(n), T.LongType())
    rated = lengths.withColumn("_hard", longest("_len") > max_group)
    easy = _composite_transform(df.join(rated.where("NOT _hard").select(*keys), keys, "left_semi"), keys, sign)
    hard_lengths = rated.where("_hard").drop("_hard")
    if hard_lengths.take(1):
        out = easy.unionByName(_chirp_transform(df.join(hard_lengths, keys), hard_lengths, keys, sign))
    else:
        out = easy
    if inverse:
        out = out.join(lengths, keys).select(*keys, "n", (F.col("re") / F.col("_len")).alias("re"), (F.col("im") / F.col("_len")).alias("im"))
    return out


def _chirp_transform(rows: DataFrame, lengths: DataFrame, keys: list[str], sign: int) -> DataFrame:
    n = F.col("_len")
    padded = F.pow(F.lit(2.0), F.ceil(F.log2((2 * n - 1).cast("double")))).cast("bigint")
    place = F.explode(F.sequence(F.lit(0).cast("bigint"), padded - 1))
    grid = lengths.select(*keys, "_len", place.alias("n"))
    # k^2 mod 2n keeps the angle exact for long series
    angle = lambda k: F.lit(math.pi) * (k * k % (2 * n)) / n
    re, im = _turned(F.col("re"), F.col("im"), sign * angle(F.col("n")))
    own = rows.select(*keys, "n", re.alias("re"), im.alias("im"))
    x = grid.join(own, [*keys, "n"], "left").select(*keys, "n", F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im"))
    back = padded - F.col("n")
    near = F.when(F.col("n") < n, F.col("n")).when(back < n, back)
    c, s = F.cos(angle(near)), F.sin(angle(near)) * F.lit(-sign)
    y = grid.select(*keys, "n", F.coalesce(c, F.lit(0.0)).alias("yre"), F.coalesce(s, F.lit(0.0)).alias("yim"))
    fx = _composite_transform(x, keys, -1)
    fy = _composite_transform(y.select(*keys, "n", F.col("yre").alias("re"), F.col("yim").alias("im")), keys, -1).select(
        *keys, "n", F.col("re").alias("yre"), F.col("im").alias("yim")
    )
    product = fx.join(fy, [*keys, "n"]).select(
        *keys, "n", (F.col("re") * F.col("yre") - F.col("im") * F.col("yim")).alias("re"),
        (F.col("re") * F.col("yim") + F.col("im") * F.col("yre")).alias("im"),
    )
    conv = _composite_transform(product, keys, 1).join(lengths, keys).where(F.col("n") < n)
    re, im = _turned(F.col("re") / padded, F.col("im") / padded, sign * angle(F.col("n")))
    return conv.select(*keys, "n", re.alias("re"), im.alias("im"))
