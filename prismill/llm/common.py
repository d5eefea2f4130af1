"""Helpers the corpus operators share: narrow inputs, white space, global positions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismill.session import checkpoint_folder, cut_lineage

#: ASCII white space as a regex class body, and words as runs of anything else
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the low 33 bits


def narrow(rows: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns can't clash with its work."""
    return rows.select(*[rows[f"`{name}`"].alias(alias) for alias, name in columns.items()])


def filled(text: str | Column) -> Column:
    """Text with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Add ``position``, 0, 1, 2, ... over the whole table in the given order.

    The range sort is Spark's own; a row's position is the number of rows in earlier partitions (one
    sum per partition) and its place in its own, so no task sees more than its range. The sorted rows
    are stored first: the ranges are sampled, and a second sort might cut elsewhere.
    """
    stored = cut_lineage(rows.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", _POSITION_BITS)
    # one row per partition of the sort
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select(
        "_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    within = F.col("_row").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        stored.withColumn("_part", part).join(before, "_part")
        .withColumn("position", F.col("_before") + within).drop("_row", "_part", "_before")
    )


def stored(rows: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder: smaller than a checkpoint, and columns can be read one by one."""
    folder = f"{checkpoint_folder(rows.sparkSession)}/table-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (``a``, ``b``, given both ways): ``node`` and ``label``, the smallest node reachable.

    Every node hears its neighbours' labels, then takes its label's label, which halves what is left of a path; the loop ends when
    nothing changes. A node's links combine before they are shuffled.
    """
    labels = cut_lineage(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    for _ in range(rounds):
        heard = links.join(labels, links["a"] == labels["node"]).groupBy(F.col("b").alias("to")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, labels["node"] == heard["to"], "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        ahead = lower.select(F.col("node").alias("of"), F.col("label").alias("next"))
        after = lower.join(ahead, lower["label"] == ahead["of"], "left").select("node", "old", F.least("label", "next").alias("label"))
        after = stored(after)  # a checkpoint would keep the guessed size, whose digits double with every round
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
