"""Text queries over the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismill.operators import words as W
from prismill.plans.registry import query, table

_STOP = ", ".join(f"'{w}'" for w in W.STOP_WORDS)
TOKENS = rf"""tk AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda w: length(w) >= 2 AND w NOT IN ({_STOP})) AS tokens FROM documents)"""
TERMS = f"""{TOKENS}, tm AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tk) GROUP BY 1, 2),
    tt AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM tm GROUP BY 1)"""
TFIDF = f"""{TERMS}, nd AS (SELECT count(*) AS n FROM documents),
    vo AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM tt, nd WHERE df >= 2 AND df <= 0.5 * n ORDER BY total DESC, term LIMIT 3000),
    ww AS (SELECT doc_id, term, tf * idf AS w FROM tm JOIN vo USING (term)),
    tw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM ww)"""


def documents(spark, folder):
    return table(spark, folder, "documents")


def terms(spark, folder):
    return W.term_rows(documents(spark, folder))


def weights(spark, folder):
    docs = documents(spark, folder)
    return W.tfidf(docs, W.term_rows(docs))


@query("tokens", "X01", f"WITH {TOKENS} SELECT doc_id, CAST(length(tokens) AS INT) AS n, array_to_string(tokens, ' ') AS tokens FROM tk")
def tokens(spark, folder):
    out = W.tokenize(documents(spark, folder))
    return out.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query("word_counts", "X02", f"WITH {TERMS} SELECT term, total, df FROM tt ORDER BY total DESC, term LIMIT 40")
def word_counts(spark, folder):
    return W.word_counts(terms(spark, folder))


@query("tfidf_weights", "X03", f"WITH {TFIDF} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM tw")
def tfidf_weights(spark, folder):
    return weights(spark, folder).withColumn("tfidf", F.round("tfidf", 6))


@query(
    "tfidf_binary",
    "X03",
    f"""WITH {TERMS}, nd AS (SELECT count(*) AS n FROM documents),
    vo AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM tt, nd WHERE df >= 5 AND df <= 0.3 * n ORDER BY df DESC, term LIMIT 500),
    ww AS (SELECT doc_id, term, idf AS w FROM tm JOIN vo USING (term))
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM ww""",
)
def tfidf_binary(spark, folder):
    docs = documents(spark, folder)
    out = W.tfidf(docs, W.term_rows(docs), min_df=5, max_df=0.3, max_features=500, binary=True)
    return out.withColumn("tfidf", F.round("tfidf", 6))


@query(
    "corpus_top_words",
    "X04",
    f"WITH {TFIDF} SELECT term, round(s, 4) AS tfidf_sum FROM (SELECT term, sum(tfidf) AS s FROM tw GROUP BY 1) ORDER BY round(s, 9) DESC, term LIMIT 40",
)
def corpus_top_words(spark, folder):
    return W.top_words(weights(spark, folder)).withColumn("tfidf_sum", F.round("tfidf_sum", 4))


@query(
    "document_top_words",
    "X05 O03",
    f"""WITH {TFIDF}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 9) DESC, term) AS k FROM tw WHERE tfidf > 0)
    SELECT doc_id, term, round(tfidf, 4) AS tfidf, CAST(k AS INT) AS rank FROM r WHERE k <= 10""",
)
def document_top_words(spark, folder):
    return W.document_top_words(weights(spark, folder)).withColumn("tfidf", F.round("tfidf", 4))


@query(
    "corpus_facts",
    "X06",
    f"""WITH {TFIDF} SELECT count(*) AS documents, CAST(sum(length(tokens)) AS BIGINT) AS tokens, round(avg(length(tokens)), 4) AS mean_length,
    CAST(min(length(tokens)) AS BIGINT) AS min_length, CAST(max(length(tokens)) AS BIGINT) AS max_length, CAST(median(length(tokens)) AS DOUBLE) AS median_length,
    (SELECT count(DISTINCT term) FROM tw) AS vocabulary, round((SELECT count(*) FROM tw) / (count(*) * (SELECT count(DISTINCT term) FROM tw)), 8) AS density FROM tk""",
)
def corpus_facts(spark, folder):
    docs = documents(spark, folder)
    rows = W.term_rows(docs)
    out = W.corpus_facts(docs, rows, W.tfidf(docs, rows))
    return out.withColumn("mean_length", F.round("mean_length", 4)).withColumn("density", F.round("density", 8))


@query(
    "rank_shift",
    "X07 J07 W11",
    f"""WITH {TFIDF}, a AS (SELECT term, row_number() OVER (ORDER BY total DESC, term) AS fr FROM (SELECT * FROM tt ORDER BY total DESC, term LIMIT 200)),
    b AS (SELECT term, row_number() OVER (ORDER BY round(s, 9) DESC, term) AS tr FROM (SELECT term, sum(tfidf) AS s FROM tw GROUP BY 1) ORDER BY round(s, 9) DESC, term LIMIT 200)
    SELECT term, CAST(fr AS INT) AS frequency_rank, CAST(tr AS INT) AS tfidf_rank, CAST(fr - tr AS INT) AS shift FROM a JOIN b USING (term) ORDER BY abs(fr - tr) DESC, fr LIMIT 15""",
)
def rank_shift(spark, folder):
    rows = terms(spark, folder)
    return W.rank_shift(W.word_counts(rows, 200), W.top_words(weights(spark, folder), 200))


_TOP = f"""{TERMS}, tp AS (SELECT term, df FROM tt ORDER BY df DESC, term LIMIT 40),
    pr AS (SELECT DISTINCT doc_id, tm.term FROM tm JOIN tp USING (term)),
    pc AS (SELECT a.term AS l, b.term AS r, count(*) AS together FROM pr a JOIN pr b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY 1, 2 HAVING count(*) >= 3),
    ed AS (SELECT l AS left_term, r AS right_term, together, round(together / (x.df + y.df - together), 4) AS jaccard
      FROM pc JOIN tp x ON x.term = l JOIN tp y ON y.term = r)"""


@query("cooccurrence_edges", "X08 J05 J06", f"WITH {_TOP} SELECT * FROM ed")
def cooccurrence_edges(spark, folder):
    return W.cooccurrence(terms(spark, folder))[1]


@query(
    "cooccurrence_nodes",
    "X08",
    f"WITH {_TOP} SELECT term, df, (SELECT count(*) FROM ed WHERE left_term = term OR right_term = term) AS links FROM tp",
)
def cooccurrence_nodes(spark, folder):
    return W.cooccurrence(terms(spark, folder))[0]


@query(
    "clean_pages",
    "C19",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&#160;', ' '), '&amp;', '&'),
      '[\s\x{A0}]+', ' ', 'g')) AS text FROM pages""",
)
def clean_pages(spark, folder):
    from prismill.sources.payloads import clean_markup

    return table(spark, folder, "pages").select("page_id", clean_markup(F.col("html")).alias("text"))
