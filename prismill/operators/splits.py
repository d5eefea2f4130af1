"""Hold-outs and cross-validation folds by repeatable shuffled ranks.

Ranks are distributed (see ``ordering``), so a class that holds most rows does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismill.functions.keys import MODULUS, scatter
from prismill.operators.ordering import ranked, running, shuffled_rank

CUT_RANGES = 1 << 16  # of the shuffled key, in which the end of the training rows is looked for


def inject_missing(df: DataFrame, names: list[str], rate: float, row_id: str, seed: int = 0) -> DataFrame:
    """Null out about ``rate`` of each named column, independently per column."""
    if rate <= 0 or not names:
        return df
    holes = {
        n: F.when(scatter(row_id, seed * 1009 + i) >= int(rate * MODULUS), F.col(n)) for i, n in enumerate(names)
    }
    return df.withColumns(holes)


def hold_out(df: DataFrame, row_id: str, stratify: str | None = None, test: float = 0.3, seed: int = 0) -> DataFrame:
    """Add ``part`` (train or test), balanced per class when every class has at least two rows."""
    if stratify is None:
        placed = shuffled_rank(df, [], row_id, "_rank", seed, grand=True)
    else:
        smallest = df.groupBy(stratify).agg(F.count("*").alias("n")).agg(F.min("n")).scalar()
        rows = df.withColumn("_stratum", F.when(smallest >= 2, F.col(stratify).cast("string")).otherwise("all"))
        placed = shuffled_rank(rows, ["_stratum"], row_id, "_rank", seed, grand=True).drop("_stratum")
    n = F.col("all__rank")
    part = F.when(F.col("_rank") <= n - F.ceil(n * F.lit(test)), "train").otherwise("test")
    return placed.withColumn("part", part).drop("_rank", "all__rank")


def hold_out_in_place(df: DataFrame, row_id: str, stratify: str, test: float = 0.3, seed: int = 0) -> DataFrame:
    """As :func:`hold_out` for few classes, without moving the rows: only those near a class's last training row are ranked.

    Rows are counted by class and range of their shuffled key, so a class's last training row is known to lie in one of ``CUT_RANGES`` ranges.
    Rows of the ranges before it train, those of the ranges after it test.
    """
    smallest = df.groupBy(stratify).agg(F.count("*").alias("n")).agg(F.min("n")).scalar()
    stratum = F.when(smallest >= 2, F.col(stratify).cast("string")).otherwise("all")
    # rows without an id come first, as in an order by the key
    place = F.coalesce(F.floor(scatter(row_id, seed) * F.lit(CUT_RANGES) / F.lit(MODULUS)).cast("int"), F.lit(-1))
    rows = df.withColumns({"_stratum": stratum, "_place": place})
    whole = Window.partitionBy("_stratum")
    counts = rows.groupBy("_stratum", "_place").agg(F.count("*").alias("_n")).withColumns({  # at most CUT_RANGES + 1 rows a class
        "_upto": F.sum("_n").over(whole.orderBy("_place")), "_all": F.sum("_n").over(whole),
    })
    train = (F.col("_all") - F.ceil(F.col("_all") * F.lit(test))).cast("long")
    # the first range that ends behind the last training row
    ends = counts.where(F.col("_upto") > train).groupBy("_stratum").agg(
        F.min(F.struct("_place", (train - F.col("_upto") + F.col("_n")).alias("_take"))).alias("_cut")
    )
    ends = F.broadcast(ends.withColumnRenamed("_stratum", "_of"))
    placed = rows.join(ends, rows["_stratum"].eqNullSafe(ends["_of"]), "left").drop("_of")
    plain = placed.where(~F.col("_place").eqNullSafe(F.col("_cut._place")))
    plain = plain.withColumn("part", F.when((F.col("_place") < F.col("_cut._place")) | F.col("_cut").isNull(), "train").otherwise("test"))
    rank = F.row_number().over(Window.partitionBy("_stratum").orderBy("_scatter", row_id))
    near = placed.where(F.col("_place") == F.col("_cut._place")).withColumn("_scatter", scatter(row_id, seed)).withColumn("_rank", rank)
    near = near.withColumn("part", F.when(F.col("_rank") <= F.col("_cut._take"), "train").otherwise("test"))
    return plain.select(*df.columns, "part").unionAll(near.select(*df.columns, "part"))


def shuffled_folds(df: DataFrame, row_id: str, splits: int = 5, stratify: str | None = None, seed: int = 0) -> DataFrame:
    """Add ``fold`` 0..splits-1, dealt out in shuffled order (of each class)."""
    placed = shuffled_rank(df, [stratify] if stratify else [], row_id, "_rank", seed)
    return placed.withColumn("fold", ((F.col("_rank") - 1) % splits).cast("int")).drop("_rank")


def contiguous_folds(df: DataFrame, order: list[str], splits: int = 5) -> DataFrame:
    """Add ``fold`` for consecutive blocks of the given order; the first blocks take the remainder."""
    n = df.agg(F.count("*")).scalar()
    placed = ranked(df, [], order, "_rank").withColumn("_n", n)
    size, extra, i = F.floor(F.col("_n") / splits), F.col("_n") % splits, F.col("_rank") - 1
    wide = extra * (size + 1)
    fold = F.when(i < wide, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - wide) / size))
    return placed.withColumn("fold", fold.cast("int")).drop("_rank", "_n")


def balanced_folds(df: DataFrame, order: list[str], label: str, splits: int = 5) -> DataFrame:
    """Add ``fold`` for consecutive blocks within each class, sizes as if classes were dealt out in turn.

    Classes count in the order they first appear.
    """
    classes = df.groupBy(label).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    ends = running(classes, [], ["_first"], {"_end": F.col("_n")})
    starts = ends.withColumn("_start", F.col("_end") - F.col("_n")).drop("_end")
    placed = ranked(df, [label], order, "_rank").join(starts, label)
    s, e = F.col("_start"), F.col("_start") + F.col("_n")

    def dealt(upto: Column) -> Column:
        """Positions of the class whose remainder is at most ``upto``."""
        def count_to(p: Column) -> Column:
            return F.floor(p / splits) * (upto + 1) + F.least(p % splits, upto + 1)

        return count_to(e) - count_to(s)

    done = F.filter(F.sequence(F.lit(0), F.lit(splits - 1)), lambda i: dealt(i) <= F.col("_rank") - 1)
    return placed.withColumn("fold", F.size(done)).drop("_rank", "_n", "_first", "_start")


def time_ordered_folds(df: DataFrame, order: list[str], splits: int = 5) -> DataFrame:
    """Add the fold (1..splits) whose test block holds the row, 0 for rows that only train."""
    n = df.agg(F.count("*")).scalar()
    placed = ranked(df, [], order, "_rank").withColumn("_n", n)
    size = F.floor(F.col("_n") / (splits + 1))
    first, i = F.col("_n") - splits * size, F.col("_rank") - 1
    fold = F.when(i >= first, F.floor((i - first) / size) + 1).otherwise(0)
    return placed.withColumn("fold", fold.cast("int")).drop("_rank", "_n")


def fold_balance(folded: DataFrame, label: str, positive) -> DataFrame:
    """Rows and positives per fold, and whether positives suffice for one per fold."""
    per = folded.groupBy("fold").agg(F.count("*").alias("rows"), F.count_if(F.col(label) == positive).alias("positives"))
    splits = per.agg(F.count("*")).scalar()
    total = per.agg(F.sum("positives")).scalar()
    return per.withColumn("too_few", total < splits)
