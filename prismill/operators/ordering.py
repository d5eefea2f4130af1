"""Ranks, running totals and exact quantiles that never put one key's rows into one task.

A window over a hot key sorts all of its rows in a single task. Here the ordered rows are first cut
into ranges by a sample of their own order keys; totals per range give every range its start
value, and the window then runs inside one range only. A key that holds a
third of the rows spreads over all the ranges its values cover.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismill.functions.keys import MODULUS, scatter

RANGE = "_range"


def _range_count(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(16, 2 * partitions)


def with_ranges(df: DataFrame, order: list[str], ranges: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Add the number of the order range a row falls in.

    The cut points are the order values of the ``ranges - 1`` rows with the smallest hashes of key and value: values that
    many keys share are sampled as often as their rows are, and the cuts follow the keys with most rows. Ranges grow with the session's
    shuffle partitions, without a ceiling. A row finds its range by binary search.
    """
    ranges = ranges or _range_count(df)
    key = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    sample = df.select(key.alias("k"), F.xxhash64(*(keys or []), *order).alias("h")).where(F.col("k").isNotNull())
    sample = sample.orderBy("h").limit(ranges - 1)
    cuts = sample.agg(F.sort_array(F.collect_set("k"))).scalar()
    halves = [1 << i for i in reversed(range(max(1, (ranges - 1).bit_length())))]

    def step(found: Column, half: Column) -> Column:
        cut = F.try_element_at("_cuts", found + half)
        return F.when(cut <= key, found + half).otherwise(found)

    place = F.aggregate(F.array(*[F.lit(h) for h in halves]), F.lit(0), step)
    return df.withColumn("_cuts", cuts).withColumn(RANGE, place).drop("_cuts")


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; the right side's keys are dropped."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    )
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in keys])


_COMBINE = {
    "sum": (F.sum, lambda a, b: a + b),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, Column],
    how: str = "sum",
    ranges: int | None = None,
    range_of: Column | None = None,
    grand: bool = False,
) -> DataFrame:
    """Add running sums (or maxima) of ``totals`` per key, up to and including each row.

    ``order`` must be unique within a key. ``range_of`` replaces the sampled cut points where the
    spread of the order key is known, as it is for scattered ids; it must not fall along the order.
    ``grand`` also adds each key's total as ``all_<name>``; it comes from the range totals for free.
    """
    aggregate, combine = _COMBINE[how]
    if range_of is not None:
        ranged = df.withColumn(RANGE, range_of)
    else:
        ranged = with_ranges(df, order, ranges, keys)
    for name, value in totals.items():
        ranged = ranged.withColumn(f"_v_{name}", value)
    per_range = ranged.groupBy(*keys, RANGE).agg(
        *[aggregate(f"_v_{n}").alias(f"_t_{n}") for n in totals]
    )
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(
        *keys, RANGE, *[aggregate(f"_t_{n}").over(before).alias(f"_s_{n}") for n in totals],
        *[aggregate(f"_t_{n}").over(whole).alias(f"all_{n}") for n in totals if grand],
    )
    inside = (
        Window.partitionBy(*keys, RANGE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = _same_keys(ranged, starts, keys + [RANGE])
    for name in totals:
        own = aggregate(f"_v_{name}").over(inside)
        start = F.col(f"_s_{name}")
        if how == "sum":
            value = combine(F.coalesce(start, F.lit(0)), own)
        else:
            value = combine(start, own)
        out = out.withColumn(name, value)
    helpers = [f"{p}_{n}" for n in totals for p in ("_v", "_s")]
    return out.drop(RANGE, *helpers)


def ranked(
    df: DataFrame, keys: list[str], order: list[str], name: str = "rank", ranges: int | None = None
) -> DataFrame:
    """Add the 1-based position of each row within its key."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")}, ranges=ranges)


def shuffled_rank(
    df: DataFrame, keys: list[str], row_id: str, name: str = "rank", seed: int = 0, grand: bool = False
) -> DataFrame:
    """Add each row's position within its key in a repeatable shuffled order of an integer id.

    With ``grand`` the key's row count is added as ``all_<name>``.
    """
    spread = df.withColumn("_scatter", scatter(row_id, seed))
    range_of = F.floor(F.col("_scatter") * F.lit(_range_count(df)) / F.lit(MODULUS)).cast("int")
    one = F.lit(1).cast("bigint")
    return running(spread, keys, ["_scatter", row_id], {name: one}, range_of=range_of, grand=grand).drop("_scatter")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    keys: list[str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per key, one column per named probability.

    Built-in exact percentiles hold every distinct value of a group in one task; here values are
    counted first and located by running counts.
    """
    keys = keys or []
    counts = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count("*").alias("_c"))
    )
    placed = running(counts, keys, ["_value"], {"_hi": F.col("_c")}, ranges=ranges, grand=True)
    placed = placed.withColumnRenamed("all__hi", "_n")
    picks = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("_n") - 1)
        for part, target in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (target < F.col("_hi")) & (target >= F.col("_hi") - F.col("_c"))
            picks.append(F.max(F.when(hit, F.col("_value"))).alias(f"_{part}_{name}"))
    found = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    columns = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("_n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        columns.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*keys, *columns)


def most_frequent(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Most frequent non-null value per key, the smallest one on a tie."""
    keys = keys or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    best = F.min(F.struct((-F.col("_c")).alias("c"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.v").alias(value), (-F.col("_b.c")).alias("n")
    )


def every_kth(df: DataFrame, order: list[str], limit: int = 5000) -> DataFrame:
    """Rows 0, k, 2k, ... of the ordered table with k = max(1, rows // limit)."""
    size = df.agg(F.count("*")).scalar()
    step = F.greatest(F.lit(1), F.floor(size / F.lit(limit)))
    placed = ranked(df, [], order, "_row")
    return placed.where((F.col("_row") - 1) % step == 0).drop("_row")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each key; an aggregate, so copies of a hot key combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)
