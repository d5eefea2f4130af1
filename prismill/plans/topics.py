"""Topic, document-cluster and document-class queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismill.operators import topics as T
from prismill.operators import words as W
from prismill.plans.registry import query, table
from prismill.plans.text import TFIDF, documents


def vectorised(spark, folder, **options):
    return T.vectorise(documents(spark, folder), **{"min_df": 5, **options})


@query("tfidf_vectors", "X03", f"WITH {TFIDF} SELECT doc_id, CAST(count(*) AS INT) AS terms, round(sum(tfidf), 5) AS mass FROM tw GROUP BY 1")
def tfidf_vectors(spark, folder):
    from pyspark.ml.functions import vector_to_array

    out = T.vectorise(documents(spark, folder)).docs
    values = F.filter(vector_to_array("tfidf"), lambda v: v != 0)
    sums = out.select("doc_id", F.size(values).alias("terms"), F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 5).alias("mass"))
    return sums.where("terms > 0")


@query("lda_topics", "X09 X11 O03")
def lda_topics(spark, folder):
    components, mixes = T.fit_lda(vectorised(spark, folder), "doc_id", topics=4)
    return T.topic_summary(components, mixes, "doc_id")


@query("nmf_topics", "X10 X11")
def nmf_topics(spark, folder):
    components, mixes, _ = T.fit_nmf(vectorised(spark, folder), "doc_id", topics=4, iterations=400)
    return T.topic_summary(components, mixes, "doc_id")


_WEIGHTS = f"""{TFIDF}, co AS (SELECT CAST(length(term) % 4 AS INT) AS topic, term, sum(tfidf) AS weight FROM tw GROUP BY 1, 2),
    mi AS (SELECT doc_id, CAST(length(term) % 4 AS INT) AS topic, sum(tfidf) AS weight FROM tw GROUP BY 1, 2)"""


def by_length(spark, folder):
    """Stand-in topics, one per remainder of the word length, to check the summaries of given weights."""
    docs = documents(spark, folder)
    weights = W.tfidf(docs, W.term_rows(docs)).withColumn("topic", (F.length("term") % 4).cast("int"))
    components = weights.groupBy("topic", "term").agg(F.round(F.sum("tfidf"), 9).alias("weight"))
    mixes = weights.groupBy("doc_id", "topic").agg(F.round(F.sum("tfidf"), 9).alias("weight"))
    return components, mixes


@query(
    "topic_summary",
    "X11 W12 O03",
    f"""WITH {_WEIGHTS}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS r FROM co),
    w AS (SELECT topic, string_agg(term, '、' ORDER BY r) AS words FROM r WHERE r <= 8 GROUP BY 1),
    d AS (SELECT doc_id, arg_min(topic, (-round(weight, 9), topic)) AS topic FROM mi GROUP BY 1)
    SELECT w.topic, words, round((SELECT count(*) FROM d WHERE d.topic = w.topic) / (SELECT count(*) FROM d), 3) AS share FROM w""",
)
def topic_summary(spark, folder):
    return T.topic_summary(*by_length(spark, folder), "doc_id")


@query(
    "dominant_topics",
    "W12",
    f"WITH {_WEIGHTS} SELECT doc_id, arg_min(topic, (-round(weight, 9), topic)) AS topic FROM mi GROUP BY 1",
)
def dominant_topics(spark, folder):
    return T.dominant_topics(by_length(spark, folder)[1], "doc_id")


@query("singular_values", "X12")
def singular_values(spark, folder):
    values, _ = T.singular_values(vectorised(spark, folder))
    return spark.createDataFrame(list(enumerate(values, 1)), "component int, value double")


@query("document_coordinates", "X12")
def document_coordinates(spark, folder):
    return T.document_coordinates(vectorised(spark, folder), "doc_id")


@query("document_clusters", "X13 O03")
def document_clusters(spark, folder):
    labels, best = T.cluster_documents(vectorised(spark, folder), 4)
    return labels.groupBy("cluster").agg(F.count("*").alias("documents")).join(best, "cluster")


@query("classified_documents", "X14 E08")
def classified_documents(spark, folder):
    return T.class_report(T.classify_documents(vectorised(spark, folder), "doc_id", "lang", 3))


@query("class_words", "X14")
def class_words(spark, folder):
    return T.class_words(vectorised(spark, folder), "doc_id", "lang")


@query(
    "classification_folds",
    "X14",
    "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT greatest(2, least(50, min(n))) AS folds FROM c",
)
def classification_folds(spark, folder):
    docs = documents(spark, folder)
    return docs.agg(F.count("*").alias("n")).select(T.fold_count(docs, "source", 50).alias("folds"))


@query("classified_turns", "X14")
def classified_turns(spark, folder):
    """The role of a conversation turn from its words."""
    turns = table(spark, folder, "conversations").withColumn("turn_id", F.col("conv_id") * 1000 + F.col("turn"))
    found = T.vectorise(turns, "turn_id", min_df=5)
    return T.class_report(T.classify_documents(found, "turn_id", "role", 2))
