"""Exact copies of articles by recipes of content-defined chunks, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismill.llm.common import BLANK, filled, narrow, same
from prismill.session import cut_lineage

#: A chunk ends after such a pair of letters once it has MIN characters, or at MAX characters. The cut only
#: looks at the text before it, so equal stretches fall into equal chunks wherever they stand.
MIN, MAX = 512, 4096
CUT = "[aeiou][bdglt]"
_CHUNK = rf"(?s).{{{MIN - 2},{MAX - 2}}}?{CUT}|(?s).{{1,{MAX}}}"


def squeezed(text: str | Column) -> Column:
    """Text without ASCII white space; null is empty."""
    return F.regexp_replace(filled(text), rf"[{BLANK}]+", "")


def chunks(squeezed_text: Column) -> Column:
    """The text cut where its own content says so; the chunks in order spell the text."""
    return F.regexp_extract_all(squeezed_text, F.lit(_CHUNK), F.lit(0))


def shared_numbers(pieces: DataFrame) -> DataFrame:
    """Numbers (``number``) that two different chunks (``chunk``) have in common.

    Every distinct chunk travels once, after copies within a task are merged. For 64 bits the expected
    count is n * n / 2 ** 65: about a thousand for the 2e11 chunks of 100 TB, none below 1 TB.
    """
    return (
        pieces.select("chunk").distinct().groupBy(F.xxhash64("chunk").alias("number"))
        .agg(F.count("*").alias("_texts")).where("_texts > 1").select("number")
    )


def exact_copies(articles: DataFrame, key: str = "URL", text: str = "要約") -> DataFrame:
    """Which article stays for each text, white space aside.

    Works on the articles of the feeds (``URL``, ``要約``) or on any table with an id and a text. Each text is
    cut into content-defined chunks; distinct chunks get numbers that are verified against all other distinct
    chunks, and two texts are equal when their ordered lists of numbers are. A number that two different
    chunks share is told apart by the chunk's SHA-256. Long texts move once, as chunks; after that only
    lists do.

    Returns one row per article: the key, ``keep_id`` (of equal texts the row with the most code points, then
    the smallest key), ``group_size``, ``kept``, ``text_sha256`` (of the text without white space) and
    ``n_chars`` (code points of the text as it came). A null text counts as empty, all empty texts are one
    group; a null key comes after all others; of repeated rows exactly one is kept. An empty table gives an
    empty result.
    """
    rows = narrow(articles, id=key, text=text)
    cut = rows.select("id", F.length(filled("text")).cast("long").alias("n_chars"), squeezed("text").alias("body"))
    cut = cut.withColumn("parts", chunks(F.col("body")))
    # nearly always empty, see shared_numbers
    unsure = [r["number"] for r in shared_numbers(cut.select(F.explode("parts").alias("chunk"))).collect()]
    doubt = F.array(*[F.lit(n) for n in unsure]).cast("array<long>")
    spelled = F.filter("parts", lambda c: F.array_contains(doubt, F.xxhash64(c))) if unsure else F.array().cast("array<string>")
    recipes = cut_lineage(
        cut.select(
            "id", "n_chars", F.transform("parts", lambda c: F.xxhash64(c)).alias("recipe"),
            F.transform(spelled, lambda c: F.sha2(c, 256)).alias("proof"),
            F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"),
        )
    )
    order = F.struct((-F.col("n_chars")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"), F.col("row").alias("d"))
    # stored, so that the join reads two plain exchanges and a crowded group's partition can be split
    groups = cut_lineage(recipes.groupBy("recipe", "proof").agg(F.count("*").alias("group_size"), F.min(order).alias("best")))
    return recipes.join(groups, ["recipe", "proof"]).select(
        F.col("id").alias(key), F.col("best.c").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.d")).alias("kept"), "text_sha256", "n_chars",
    )


def without_copies(articles: DataFrame, key: str = "URL", text: str = "要約") -> DataFrame:
    """The articles, all columns, that :func:`exact_copies` keeps: one per distinct text."""
    kept = exact_copies(articles, key, text).where("kept").select(
        F.col(key).alias("_keep"), F.col("text_sha256").alias("_hash"), F.col("n_chars").alias("_length")
    )
    marked = articles.withColumns({
        "_digest": F.sha2(squeezed(articles[f"`{text}`"]).cast("binary"), 256),
        "_chars": F.length(filled(articles[f"`{text}`"])).cast("long"),
    })
    match = same(marked[f"`{key}`"], kept["_keep"]) & (marked["_digest"] == kept["_hash"]) & (marked["_chars"] == kept["_length"])
    # repeated rows of one key: the join's own partitioning serves this too
    return marked.join(kept, match, "left_semi").dropDuplicates([key, "_digest", "_chars"]).drop("_digest", "_chars")
