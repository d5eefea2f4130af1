"""Mix articles of several sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from prismill.llm.common import filled, narrow, numbered, same
from prismill.session import cut_lineage

SEGMENT = 8192  # rows of one source that one group settles


@F.pandas_udf(LongType())
def _word_count(text: pd.Series) -> pd.Series:
    return text.map(lambda t: len(t.split()))  # bytes split at ASCII white space only


def target_sizes(sources: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), repeats: float = 3.0) -> DataFrame:
    """Add ``weight`` and ``target`` to sources (``source``, ``source_size``).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes by weight. A
    target stops at ``repeats`` times its source's size; the excess is shared anew by weight until none is above.
    Each round of sharing is one sum over the sources; the driver holds one rate.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(numbered(sources, F.col("source").asc_nulls_last()).withColumn("weight", turn).drop("position"))
    limit = F.col("source_size") * F.lit(float(repeats))
    rate, full = 0.0, -1
    while True:
        above = limit <= F.lit(rate) * F.col("weight")
        row = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.count(F.when(above, 1)).alias("n"),
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)).alias("spent"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if row["n"] == full or not row["open"]:
            break
        full, rate = row["n"], (row["all"] - row["spent"]) / row["open"]
    return ranked.withColumn("target", F.least(limit, F.lit(rate) * F.col("weight")))


def pivot(size: np.ndarray, share: np.ndarray, luck: np.ndarray, last: bool) -> tuple[np.ndarray, int]:
    """Round shares of a copy to 0 or 1 while the words they stand for keep their sum.

    A row is paired with the open rows after it, and one coin, heads with the row's share, decides for all of its
    pairs: the row is rounded up by the words they give, or down and they get its words. Neither way makes
    a partner's share leave 0 to 1, and its expectation stays. Rows go from long to short, so what is
    left at the end is short. Rows whose partners have too little room exchange words in pairs until one of the two
    is integral. Returns the rounded shares and the place of the row left open (-1: none); with
    ``last`` that row goes to the nearer side.
    """
    tiny = 1e-9
    out = np.where(size > 0, share, 0.0)
    out = np.where(out <= tiny, 0.0, np.where(out >= 1 - tiny, 1.0, out)).tolist()
    words, coin, n = size.tolist(), luck.tolist(), len(out)

    def put(i: int, value: float) -> None:
        out[i] = 0.0 if value <= tiny else 1.0 if value >= 1 - tiny else value

    late = []
    for i in range(n):
        p = out[i]
        if p in (0.0, 1.0):
            continue
        partners, missing, j = [], words[i], i + 1
        while missing > tiny and j < n:
            q = out[j]
            if q not in (0.0, 1.0):
                room = min(words[j] * min(q / (1 - p), (1 - q) / p), missing)
                partners.append((j, room))
                missing -= room
            j += 1
        if missing > tiny:
            late.append(i)
            continue
        up = coin[i] < p
        for j, room in partners:
            put(j, out[j] + (-(1 - p) if up else p) * room / words[j])
        out[i] = 1.0 if up else 0.0
    held = -1
    for i in late:
        if out[i] in (0.0, 1.0):
            continue
        if held < 0:
            held = i
            continue
        a, b = words[held], words[i]
        up = min((1 - out[held]) * a, out[i] * b)
        down = min(out[held] * a, (1 - out[i]) * b)
        move = up if coin[i] * (up + down) < down else -down
        put(held, out[held] + move / a)
        put(i, out[i] - move / b)
        if out[held] in (0.0, 1.0):
            held = -1 if out[i] in (0.0, 1.0) else i
    if held >= 0 and last:
        out[held], held = (1.0 if out[held] >= 0.5 else 0.0), -1
    return np.array(out), held


def _settle(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # long rows first, so that what stays open is short
        rows = rows.sort_values(["size", "luck", "id", "own"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        share, held = pivot(rows["size"].to_numpy(float), rows["share"].to_numpy(float), rows["luck"].to_numpy(float), last)
        return rows.drop(columns="segment").assign(share=share, open=np.arange(len(rows)) == held)

    return run


def mix_sources(
    articles: DataFrame, key: str = "URL", text: str = "要約", source: str = "配信元",
    weights: Sequence[float] = (1.0, 2.0, 3.0), repeats: float = 3.0, seed: int = 0,
) -> DataFrame:
    """How often each article is taken so that its source comes to its target number of words.

    Works on the articles of the feeds (``URL``, ``要約``, ``配信元``) or on any table with an id, a text and a
    source. A source's target over its size is the number of copies of each of its articles: the whole
    part is taken outright, the fraction is rounded by pivotal sampling over words. Segments of a
    source (by a hash of the key) settle all but one article each, the open ones meet in the next level of a
    reduction tree, and the last one of a source goes to the nearer side. So a source misses its target by less than
    half of one, mostly short, article.

    Returns one row per article: the key, ``size`` (words between ASCII white space), ``source_size``, ``target``
    (its source's), ``copies`` (0 to ``repeats``) and ``taken`` (copies * size). The draws are hashes of key, size and ``seed``,
    so reruns agree. Null texts have size 0, and articles without words get the whole part only; null sources are
    one source, the last; repeated rows are drawn one by one. An empty table gives an empty result.
    """
    drawn = _drawn(narrow(articles, id=key, text=text, source=source).withColumn("own", F.lit(None).cast("binary")), weights, repeats, seed)
    return drawn.select(F.col("id").alias(key), "size", "source_size", "target", "copies", "taken")


def _drawn(rows: DataFrame, weights: Sequence[float], repeats: float, seed: int) -> DataFrame:
    """:func:`mix_sources` on rows (``id``, ``text``, ``source``, ``own``); ``own``, if not null, tells rows without an id apart."""
    sized = cut_lineage(rows.select("id", "own", "source", _word_count(filled("text").cast("binary")).alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    totals = cut_lineage(target_sizes(totals, weights, repeats))
    largest = totals.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("n")).first()["n"]

    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(copies + F.lit(1e-9)).cast("long")
    mixed = sized.join(totals.withColumnRenamed("source", "_source"), same(F.col("source"), F.col("_source"))).drop("_source")
    apart = F.when(F.col("id").isNull(), F.col("own"))  # hashes pass over nulls, so an id's draw does not depend on it
    luck = F.shiftrightunsigned(F.xxhash64("id", "size", apart, F.lit(seed)), 11) / F.lit(float(1 << 53))
    level = mixed.select(
        "id", "own", "source", "size", "source_size", "target", base.alias("base"), F.greatest(copies - base, F.lit(0.0)).alias("share"),
        luck.alias("luck"), F.col("rows").alias("peers"),
    )
    settled = []
    depth = 0
    while True:
        last = largest <= SEGMENT
        groups = F.ceil(F.col("peers") / SEGMENT)
        level = level.withColumn("segment", F.pmod(F.xxhash64("id", "size", apart, F.lit(seed + 1 + depth)), groups))
        names = [c for c in level.columns if c != "segment"]
        schema = ", ".join(f"`{c}` {t}" for c, t in level.select(*names).dtypes) + ", open boolean"
        done = cut_lineage(level.groupBy("source", "segment").applyInPandas(_settle(last), schema))
        settled.append(done.where("not open"))
        if last:
            break
        # the reduction tree: one open row of each segment goes on
        largest = -(-largest // SEGMENT)
        level = done.where("open").drop("open").withColumn("peers", F.ceil(F.col("peers") / SEGMENT))
        depth += 1
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    number = F.col("base") + F.col("share").cast("long")
    return out.select("id", "own", "source", "size", "source_size", "target", number.alias("copies"), (number * F.col("size")).alias("taken"))


def mixed_articles(
    articles: DataFrame, key: str = "URL", text: str = "要約", source: str = "配信元",
    weights: Sequence[float] = (1.0, 2.0, 3.0), repeats: float = 3.0, seed: int = 0,
) -> DataFrame:
    """The articles, all columns, each as often as :func:`mix_sources` takes it.

    Rows with equal keys, texts and sources are one article, which is taken as often as all of them are. Texts that share a
    key or have none are known apart by their digest, so each is taken by its own copies.
    """
    own = F.unhex(F.md5(filled(articles[f"`{text}`"]).cast("binary")))
    drawn = _drawn(narrow(articles, id=key, text=text, source=source).withColumn("own", F.unhex(F.md5(filled("text").cast("binary")))), weights, repeats, seed)
    drawn = drawn.groupBy(F.col("id").alias("_taken"), F.col("own").alias("_text"), F.col("source").alias("_from"))
    drawn = drawn.agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    once = articles.withColumn("_own", own).dropDuplicates([key, "_own", source])
    this = same(once[f"`{key}`"], drawn["_taken"]) & (once["_own"] == drawn["_text"]) & same(once[f"`{source}`"], drawn["_from"])
    return (
        once.join(drawn, this)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_own", "_taken", "_text", "_from", "_copies", "_copy")
    )
