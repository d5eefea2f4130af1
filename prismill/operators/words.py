"""Tokens, counts, TF-IDF and co-occurrence on document tables.

The document-term matrix is a long table ``(doc_id, term, weight)`` here.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismill.operators.ordering import exact_quantiles

# Words without content of their own, for the languages of the document table.
STOP_WORDS = (
    "the and of to in that is for it on as with by at this are was be an or from "
    "der die das und ist nicht ein eine mit auf zu den von im dem des "
    "le la les de des et un une est que qui dans pour en du au "
    "el los las del y es por con una para se lo como"
).split()
TERM_ROWS = 1 << 16  # terms that leave a task at once, besides those of one document


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def _kept(word: Column, min_length: int, stop_words: list[str] | None) -> Column:
    stop = STOP_WORDS if stop_words is None else stop_words
    long_enough = F.length(word) >= min_length
    return long_enough & ~word.isin(stop) if stop else long_enough


def tokens_of(text: Column, min_length: int = 2, stop_words: list[str] | None = None) -> Column:
    """Lower-cased words of a text: runs of letters, long enough, without stop words."""
    return F.filter(_words(text), lambda w: _kept(w, min_length, stop_words))


def tokenize(docs: DataFrame, text: str = "text", out: str = "tokens", **options) -> DataFrame:
    return docs.withColumn(out, tokens_of(F.col(text), **options))


def _counted(kept: list[str], min_length: int, stop: frozenset[str]) -> Callable:
    """Terms of every document of a batch, a row each; no more leave at once than ``TERM_ROWS`` and those of one document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = regex.compile(r"\p{L}+")
        for batch in batches:
            rows, terms, times = [], [], []
            for row, words in enumerate(batch.column(len(kept))):
                found = Counter(letters.findall(words.as_py() or ""))
                own = [w for w in found if len(w) >= min_length and w not in stop]
                rows += [row] * len(own)
                terms += own
                times += [found[w] for w in own]
                if rows and (len(rows) >= TERM_ROWS or row == len(batch) - 1):
                    columns = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(kept)]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(terms, pa.string()), pa.array(times, pa.int64())], names=[*kept, "term", "tf"])
                    rows, terms, times = [], [], []

    return count


def term_rows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
    min_length: int = 2, stop_words: list[str] | None = None,
) -> DataFrame:
    """Long form ``(doc_id, term, tf)``: a document sits in one row, so its terms are counted there and nothing is shuffled.

    Ids name one row each; the terms of rows that share one would stay apart.
    """
    kept = [doc_id, *(keep or [])]
    stop = frozenset(STOP_WORDS if stop_words is None else stop_words)
    narrow = docs.select(*kept, F.lower(F.col(text)).alias("_lower"))
    fields = ", ".join(f"`{name}` {kind}" for name, kind in narrow.dtypes[:-1])
    return narrow.mapInArrow(_counted(kept, min_length, stop), f"{fields}, term string, tf bigint")


def term_totals(terms: DataFrame) -> DataFrame:
    """Occurrences and documents of every term."""
    return terms.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))


def word_counts(terms: DataFrame, top: int = 40) -> DataFrame:
    return term_totals(terms).orderBy(F.desc("total"), "term").limit(top)


def vocabulary(
    terms: DataFrame, n_docs: Column, min_df: int = 2, max_df: float = 0.5,
    max_features: int | None = 3000, binary: bool = False,
) -> DataFrame:
    """Kept terms with their inverse document frequency ln((1 + n) / (1 + df)) + 1."""
    totals = term_totals(terms).withColumn("n", n_docs)
    kept = totals.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n")))
    if max_features is not None:
        kept = kept.orderBy(F.desc("df" if binary else "total"), "term").limit(max_features)
    return kept.select("term", "total", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(
    docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", min_df: int = 2, max_df: float = 0.5,
    max_features: int | None = 3000, binary: bool = False,
) -> DataFrame:
    """Length-normalised TF-IDF weights in long form; ``docs`` counts every document, empty ones too."""
    n_docs = docs.agg(F.count("*")).scalar()
    words = vocabulary(terms, n_docs, min_df, max_df, max_features, binary).select("term", "idf")
    tf = F.lit(1) if binary else F.col("tf")
    weighted = terms.join(words, "term").withColumn("_w", tf * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc_id)))
    return weighted.select(doc_id, "term", (F.col("_w") / length).alias("tfidf"))


def top_words(weights: DataFrame, top: int = 40) -> DataFrame:
    """Terms by the sum of their weights over all documents."""
    sums = weights.groupBy("term").agg(F.sum("tfidf").alias("tfidf_sum"))
    return sums.orderBy(F.desc(F.round("tfidf_sum", 9)), "term").limit(top)


def document_top_words(weights: DataFrame, doc_id: str = "doc_id", top: int = 10) -> DataFrame:
    """Terms that mark each document, heaviest first."""
    place = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.desc(F.round("tfidf", 9)), "term"))
    return weights.where("tfidf > 0").withColumn("rank", place).where(F.col("rank") <= top)


def rank_shift(counts: DataFrame, by_weight: DataFrame, top: int = 15) -> DataFrame:
    """Words in both top lists by how far their ranks differ. Both lists are short by construction."""
    frequency = counts.select("term", F.row_number().over(Window.orderBy(F.desc("total"), "term")).alias("frequency_rank"))
    weight = by_weight.select(
        "term", F.row_number().over(Window.orderBy(F.desc(F.round("tfidf_sum", 9)), "term")).alias("tfidf_rank")
    )
    both = frequency.join(weight, "term").withColumn("shift", F.col("frequency_rank") - F.col("tfidf_rank"))
    return both.orderBy(F.desc(F.abs("shift")), "frequency_rank").limit(top)


def corpus_facts(docs: DataFrame, terms: DataFrame, weights: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row: documents, tokens, document length statistics, vocabulary and matrix density."""
    lengths = terms.groupBy(doc_id).agg(F.sum("tf").alias("tokens"))
    every = docs.select(doc_id).join(lengths, doc_id, "left").select(F.coalesce("tokens", F.lit(0)).cast("double").alias("tokens"))
    cells = weights.agg(F.count("*")).scalar()
    words = weights.agg(F.count_distinct("term")).scalar()
    middle = exact_quantiles(every, "tokens", {"m": 0.5}).select("m").scalar()
    return every.agg(
        F.count("*").alias("documents"), F.sum("tokens").cast("bigint").alias("tokens"), F.avg("tokens").alias("mean_length"),
        F.min("tokens").cast("bigint").alias("min_length"), F.max("tokens").cast("bigint").alias("max_length"),
    ).withColumns({"median_length": middle, "vocabulary": words}).withColumn(
        "density", cells / (F.col("documents") * F.col("vocabulary"))
    )


def cooccurrence(
    terms: DataFrame, doc_id: str = "doc_id", top: int = 40, min_together: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graph of words that share documents.

    Documents are first reduced to the set of top words they hold, and equal sets are counted, so
    pairs are formed once per distinct set of at most ``top`` words.
    """
    frequent = term_totals(terms).orderBy(F.desc("df"), "term").limit(top).select("term", "df")
    present = terms.join(F.broadcast(frequent.select("term")), "term", "left_semi")
    sets = present.groupBy(doc_id).agg(F.sort_array(F.collect_set("term")).alias("words"))
    counted = sets.groupBy("words").agg(F.count("*").alias("n"))
    left = counted.select("words", "n", F.posexplode("words").alias("i", "left_term"))
    pairs = left.select("n", "left_term", F.explode(F.slice("words", F.col("i") + 2, F.lit(top))).alias("right_term"))
    together = pairs.groupBy("left_term", "right_term").agg(F.sum("n").alias("together")).where(F.col("together") >= min_together)
    a = frequent.select(F.col("term").alias("left_term"), F.col("df").alias("_a"))
    b = frequent.select(F.col("term").alias("right_term"), F.col("df").alias("_b"))
    edges = together.join(a, "left_term").join(b, "right_term").select(
        "left_term", "right_term", "together",
        F.round(F.col("together") / (F.col("_a") + F.col("_b") - F.col("together")), 4).alias("jaccard"),
    )
    ends = edges.select(F.explode(F.array("left_term", "right_term")).alias("term")).groupBy("term").agg(F.count("*").alias("links"))
    nodes = frequent.join(ends, "term", "left").select("term", "df", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    return nodes, edges.orderBy(F.desc("jaccard"), "left_term", "right_term")
