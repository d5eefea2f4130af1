"""Topics, clusters and classes of documents on sparse TF-IDF vectors.

The vocabulary is at most a few thousand terms and is a model parameter; documents become sparse
vectors by JVM stages without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import classification as MC
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismill.operators import metrics, words
from prismill.operators.models import TrainingFacts, with_label
from prismill.operators.splits import shuffled_folds
from prismill.operators.validation import side_by_side
from prismill.session import cut_lineage


@dataclass
class Vectorised:
    """Documents with a ``tfidf`` vector, and the terms its places stand for."""

    docs: DataFrame
    terms: list[str]

    def names(self) -> Column:
        return F.array(*[F.lit(t) for t in self.terms])


def vectorise(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_df: int = 2, max_df: float = 0.5,
    max_features: int = 3000, binary: bool = False, **tokens,
) -> Vectorised:
    """The weights of ``words.tfidf`` as sparse vectors."""
    rows = words.term_rows(docs, doc_id, text, **tokens)
    n_docs = docs.agg(F.count("*")).scalar()
    found = words.vocabulary(rows, n_docs, min_df, max_df, max_features, binary).orderBy("term").select("term", "idf").collect()
    if not found:
        raise ValueError("no term is left; lower min_df or raise max_df")
    terms = [r["term"] for r in found]
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="_tokens", outputCol="_counts", minTF=1)
    counter.setBinary(binary)
    weigher = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in found]), inputCol="_counts", outputCol="_weighted")
    out = words.tokenize(docs, text, "_tokens", **tokens)
    out = Normalizer(p=2.0, inputCol="_weighted", outputCol="tfidf").transform(weigher.transform(counter.transform(out)))
    return Vectorised(out.drop("_tokens", "_counts", "_weighted"), terms)


# --- topics --------------------------------------------------------------------------


def fit_lda(vectorised: Vectorised, doc_id: str, topics: int = 6, iterations: int = 30, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Topic-term and document-topic weights of a batch variational fit."""
    from pyspark.ml.clustering import LDA

    rows = vectorised.docs.select(doc_id, F.col("tfidf").alias("features")).persist()
    lda = LDA(k=topics, maxIter=iterations, optimizer="online", subsamplingRate=1.0, optimizeDocConcentration=False, seed=seed)
    model = lda.fit(rows)
    matrix = model.topicsMatrix().toArray()
    components = _components(vectorised, matrix.T)
    mixes = model.transform(rows).select(doc_id, F.posexplode(vector_to_array("topicDistribution")).alias("topic", "weight"))
    return components, mixes


def _components(vectorised: Vectorised, h: np.ndarray) -> DataFrame:
    """Topics times terms numbers as rows (topic, term, weight)."""
    topic, place = np.indices(h.shape)
    table = pd.DataFrame({"topic": topic.ravel(), "term": np.array(vectorised.terms, dtype=object)[place.ravel()], "weight": h.ravel()})
    return vectorised.docs.sparkSession.createDataFrame(table, "topic int, term string, weight double")


def fit_nmf(
    vectorised: Vectorised, doc_id: str, topics: int = 6, iterations: int = 50, tol: float = 1e-4, seed: int = 0, cut_every: int = 5
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Nonnegative factors by multiplicative updates (Lee & Seung 2001), and the loss of every round.

    The topic-term matrix (topics x vocabulary) is a model parameter and travels with the tasks. A
    document's weights stay in its row; partitions return partial sums only.
    """
    rng = np.random.default_rng(seed)
    width = len(vectorised.terms)
    parse = _sparse_parts(vectorised.docs, doc_id)
    scale = float(np.sqrt(max(parse.agg(F.avg(F.aggregate("val", F.lit(0.0), lambda a, v: a + v))).first()[0] or 0.0, 1e-12) / width / topics))
    h = scale * (0.5 + rng.random((topics, width)))
    start = F.array(*[F.lit(scale * (0.5 + float(v))) for v in rng.random(topics)])
    state = cut_lineage(parse.withColumn("w", start))
    losses: list[float] = []
    for i in range(iterations):
        state = state.withColumn("w", _update_rows(h)("idx", "val", "w"))
        if (i + 1) % cut_every == 0:
            state = cut_lineage(state)
        gathered = state.mapInPandas(_partial_sums(h), "kind string, place bigint, sums array<double>")
        rows = gathered.groupBy("kind", "place").agg(
            F.array(*[F.sum(F.get("sums", F.lit(t))) for t in range(topics)]).alias("sums")
        ).collect()
        wx, ww, loss = np.zeros((topics, width)), np.zeros((topics, topics)), 0.0
        for r in rows:
            if r["kind"] == "x":
                wx[:, r["place"]] = r["sums"]
            elif r["kind"] == "w":
                ww[:, r["place"]] = r["sums"]
            else:
                loss = float(r["sums"][0])
        losses.append(loss)
        h = h * wx / np.maximum(ww @ h, 1e-12)
        if len(losses) > 1 and losses[-2] - losses[-1] <= tol * losses[0]:
            break
    mixes = state.select(doc_id, F.posexplode("w").alias("topic", "weight"))
    return _components(vectorised, h), mixes, losses


def _sparse_parts(docs: DataFrame, doc_id: str) -> DataFrame:
    """Places and values of the nonzero weights of each document."""
    dense = F.transform(vector_to_array("tfidf"), lambda v, i: F.struct(i.cast("int").alias("i"), v.alias("v")))
    kept = F.filter(dense, lambda p: p["v"] != 0)
    rows = docs.select(doc_id, kept.alias("_p"))
    return rows.select(doc_id, F.transform("_p", lambda p: p["i"]).alias("idx"), F.transform("_p", lambda p: p["v"]).alias("val"))


def _update_rows(h: np.ndarray):
    hh = h @ h.T

    @F.pandas_udf("array<double>")
    def update(idx: pd.Series, val: pd.Series, w: pd.Series) -> pd.Series:
        def one(i, v, row) -> np.ndarray:
            row = np.asarray(row)
            return row * (h[:, np.asarray(i, dtype=int)] @ np.asarray(v)) / np.maximum(hh @ row, 1e-12)

        return pd.Series([one(*z) for z in zip(idx, val, w)], index=idx.index, dtype=object)

    return update


def _partial_sums(h: np.ndarray):
    hh = h @ h.T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        topics, width = h.shape
        wx, ww, loss, any_rows = np.zeros((topics, width)), np.zeros((topics, topics)), 0.0, False
        for batch in batches:
            for i, v, row in zip(batch["idx"], batch["val"], batch["w"]):
                i, v, row = np.asarray(i, dtype=int), np.asarray(v, dtype=float), np.asarray(row)
                any_rows = True
                wx[:, i] += np.outer(row, v)
                ww += np.outer(row, row)
                loss += v @ v - 2 * (row @ (h[:, i] @ v)) + row @ hh @ row
        if any_rows:
            used = np.flatnonzero(wx.any(axis=0))
            rows = [("x", int(j), wx[:, j].tolist()) for j in used] + [("w", j, ww[:, j].tolist()) for j in range(topics)]
            rows.append(("loss", 0, [loss] + [0.0] * (topics - 1)))
            yield pd.DataFrame(rows, columns=["kind", "place", "sums"])

    return run


def topic_words(components: DataFrame, top: int = 8) -> DataFrame:
    """Heaviest words of each topic."""
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))
    return components.withColumn("rank", place).where(F.col("rank") <= top)


def topic_labels(components: DataFrame, n_words: int = 3, separator: str = "・") -> DataFrame:
    """A topic's number and its heaviest words as one text."""
    best = topic_words(components, n_words)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda p: p["term"]), separator)
    return best.groupBy("topic").agg(joined.alias("words"))


def dominant_topics(mixes: DataFrame, doc_id: str) -> DataFrame:
    """Each document's strongest topic, the lowest number on a tie."""
    best = F.min(F.struct((-F.col("weight")).alias("w"), "topic"))
    return mixes.groupBy(doc_id).agg(best.alias("b")).select(doc_id, F.col("b.topic").alias("topic"))


def topic_summary(components: DataFrame, mixes: DataFrame, doc_id: str, top: int = 8) -> DataFrame:
    """Words of every topic and the share of documents it dominates."""
    lead = dominant_topics(mixes, doc_id)
    shares = lead.groupBy("topic").agg(F.count("*").alias("_n"))
    total = lead.agg(F.count("*")).scalar()
    out = topic_labels(components, top, "、").join(shares, "topic", "left").withColumn("_all", total)
    return out.select("topic", "words", F.round(F.coalesce("_n", F.lit(0)) / F.col("_all"), 3).alias("share"))


# --- reduction, clusters, classes ------------------------------------------------------


def singular_values(vectorised: Vectorised, limit: int = 50) -> tuple[list[float], np.ndarray]:
    """Leading singular values of the matrix and the term side of the decomposition."""
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    n_docs = vectorised.docs.count()
    k = max(2, min(limit, n_docs - 1, len(vectorised.terms) - 1))
    # the solver reads the rows many times
    rows = MLUtils.convertVectorColumnsFromML(vectorised.docs.select("tfidf"), "tfidf").persist()
    try:
        found = RowMatrix(rows).computeSVD(k, computeU=False)
        return [float(v) for v in found.s], found.V.toArray()
    finally:
        rows.unpersist()


def document_coordinates(vectorised: Vectorised, doc_id: str, limit: int = 50) -> DataFrame:
    """Documents projected on the leading components."""
    _, v = singular_values(vectorised, limit)

    @F.pandas_udf("array<double>")
    def project(idx: pd.Series, val: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x) @ v[np.asarray(i, dtype=int)] for i, x in zip(idx, val)], index=idx.index, dtype=object)

    return _sparse_parts(vectorised.docs, doc_id).select(doc_id, project("idx", "val").alias("coordinates"))


def cluster_documents(vectorised: Vectorised, clusters: int = 5, seed: int = 0, top: int = 6) -> tuple[DataFrame, DataFrame]:
    """Cluster of every document and the heaviest words of every center."""
    from pyspark.ml.clustering import KMeans

    model = KMeans(k=clusters, seed=seed, featuresCol="tfidf", predictionCol="cluster").fit(vectorised.docs)
    centers = _components(vectorised, np.stack(model.clusterCenters()))
    return model.transform(vectorised.docs), topic_words(centers, top).withColumnRenamed("topic", "cluster")


def fold_count(df: DataFrame, label: str, wanted: int = 5) -> Column:
    """Folds a classification can have: not more than the smallest class has rows, at least two."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    return F.greatest(F.lit(2).cast("bigint"), F.least(F.lit(wanted).cast("bigint"), sizes.agg(F.min("n")).scalar()))


def _learner(rows: int) -> MC.LogisticRegression:
    return MC.LogisticRegression(regParam=1.0 / rows, standardization=False, maxIter=200, tol=1e-4)


def _labelled(vectorised: Vectorised, doc_id: str, label: str) -> tuple[DataFrame, list[str]]:
    docs = vectorised.docs.where(F.col(label).isNotNull())
    docs = docs.select(doc_id, F.col(label).cast("string").alias("actual"), F.col("tfidf").alias("features"))
    # one string per class
    labels = [r["actual"] for r in docs.select("actual").distinct().orderBy("actual").collect()]
    return with_label(docs, "actual", labels), labels


def classify_documents(vectorised: Vectorised, doc_id: str, label: str, splits: int = 5, seed: int = 0) -> DataFrame:
    """Actual and predicted class of every document, predicted by a model that has not seen it."""
    rows, labels = _labelled(vectorised, doc_id, label)
    splits = int(rows.sparkSession.range(1).select(fold_count(rows, "actual", splits)).first()[0])
    folded = shuffled_folds(rows, doc_id, splits, "actual", seed).persist()
    sizes = {r["fold"]: r["n"] for r in folded.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())

    def one(i: int) -> DataFrame:
        rows_left = total - sizes.get(i, 0)
        facts = TrainingFacts(rows_left, len(labels), 1.0)
        model = _learner(rows_left).fit(folded.where(F.col("fold") != i))
        return model.transform(folded.where(F.col("fold") == i))

    parts = side_by_side(rows.sparkSession, [lambda i=i: one(i) for i in range(splits)])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    names = F.array(*[F.lit(v) for v in labels])
    return out.select(doc_id, "actual", F.get(names, F.col("prediction").cast("int")).alias("predicted"))


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of the classes that occur, three decimals."""
    report = metrics.class_report(predictions, "actual", "predicted").where("support > 0")
    return report.select("class", "support", *[F.round(c, 3).alias(c) for c in ("precision", "recall", "f1")])


def class_words(vectorised: Vectorised, doc_id: str, label: str, top: int = 8) -> DataFrame:
    """The words with the largest coefficients of each class, from a fit on all documents."""
    rows, labels = _labelled(vectorised, doc_id, label)
    facts = TrainingFacts(rows.count(), len(labels), 1.0)
    matrix = _learner(facts.rows).fit(rows).coefficientMatrix.toArray()
    if len(labels) == 2 and matrix.shape[0] == 1:
        matrix = np.repeat(matrix, 2, axis=0)
    best = []
    for name, row in zip(labels, matrix):
        order = np.argsort(-row, kind="stable")[:top]
        best += [(name, r + 1, vectorised.terms[j], float(row[j])) for r, j in enumerate(order)]
    return rows.sparkSession.createDataFrame(best, "class string, rank int, term string, weight double")
