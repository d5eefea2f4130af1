"""Evaluation queries: document quality as truth, text length as score."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismill.functions.rounding import settled, settled_sql
from prismill.operators import metrics
from prismill.plans.registry import query, table


def scored(spark, folder):
    labels, docs = table(spark, folder, "labels"), table(spark, folder, "documents")
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), (F.least(F.col("n_chars"), F.lit(5000)) / 5000.0).alias("score")
    )


SCORED = """sc AS (SELECT l.doc_id, quality AS y, least(n_chars, 5000) / 5000.0::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id))"""

_COUNTS = """SELECT count(*) FILTER (WHERE y = 1 AND score >= {t}) AS tp, count(*) FILTER (WHERE y <> 1 AND score >= {t}) AS fp,
    count(*) FILTER (WHERE y = 1 AND score < {t}) AS fn, count(*) FILTER (WHERE y <> 1 AND score < {t}) AS tn FROM sc"""


@query("binary_confusion", "E01", f"WITH {SCORED} {_COUNTS.format(t=0.2)}")
def binary_confusion(spark, folder):
    return metrics.binary_confusion(scored(spark, folder), "y", "score", 0.2)


_RATES = """
    m AS (SELECT *, (tp + tn) / greatest(tp + fp + fn + tn, 1) AS accuracy, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r,
      tn / greatest(tn + fp, 1) AS specificity, (tp + fn) / greatest(tp + fp + fn + tn, 1) AS base_rate FROM c)
"""


@query(
    "confusion_metrics",
    "E02",
    f"""WITH {SCORED}, c AS ({_COUNTS.format(t=0.2)}), {_RATES}
    SELECT tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(specificity, 6) AS specificity,
    round(base_rate, 6) AS base_rate, round(2 * p * r / greatest(p + r, 1e-12), 6) AS f1, round((r + specificity) / 2, 6) AS balanced_accuracy,
    round(greatest(base_rate, 1 - base_rate), 6) AS majority_accuracy FROM m""",
)
def confusion_metrics(spark, folder):
    out = metrics.confusion_metrics(metrics.binary_confusion(scored(spark, folder), "y", "score", 0.2))
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in out.columns[4:]])


STEPS = f"""{SCORED}, g AS (SELECT score AS threshold, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM sc GROUP BY 1),
    st AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg
      FROM g WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    "roc_curve",
    "E03",
    f"WITH {STEPS} SELECT threshold, tp, fp, round(fp / all_neg, 6) AS fpr, round(tp / all_pos, 6) AS tpr FROM st",
)
def roc_curve(spark, folder):
    out = metrics.roc_curve(metrics.score_steps(scored(spark, folder), "y", "score"))
    return out.select("threshold", "tp", "fp", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(
    "roc_auc",
    "E04",
    f"WITH {STEPS} SELECT round(sum(neg * (tp - pos / 2)) / max(all_pos * all_neg), 8) AS auc FROM st",
)
def roc_auc(spark, folder):
    return metrics.roc_auc(metrics.score_steps(scored(spark, folder), "y", "score")).select(F.round("auc", 8).alias("auc"))


@query(
    "roc_auc_one_vs_rest",
    "E04",
    """
    WITH sc AS (SELECT c.c AS class, CASE WHEN label = c.c THEN 1 ELSE 0 END AS y, CAST(embedding[c.c + 1] AS DOUBLE) AS score
      FROM embeddings, (SELECT unnest(range(10)) AS c) c),
    g AS (SELECT class, score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM sc GROUP BY 1, 2),
    st AS (SELECT *, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY class) AS ap, sum(neg) OVER (PARTITION BY class) AS an
      FROM g WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT class, sum(neg * (tp - pos / 2)) / max(ap * an) AS auc FROM st GROUP BY class)
    SELECT round(avg(auc), 8) AS auc FROM a
    """,
)
def roc_auc_one_vs_rest(spark, folder):
    rows = table(spark, folder, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 10)).alias("class", "score"))
    rows = rows.withColumn("y", (F.col("label") == F.col("class")).cast("int"))
    per_class = metrics.roc_auc(metrics.score_steps(rows, "y", "score", ["class"]), ["class"])
    return metrics.macro_auc(per_class).select(F.round("auc", 8).alias("auc"))


@query(
    "precision_recall_curve",
    "E05",
    f"WITH {STEPS} SELECT threshold, tp, fp, round(tp / (tp + fp), 6) AS precision, round(tp / all_pos, 6) AS recall FROM st",
)
def precision_recall_curve(spark, folder):
    out = metrics.precision_recall_curve(metrics.score_steps(scored(spark, folder), "y", "score"))
    return out.select("threshold", "tp", "fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    "average_precision",
    "E05",
    f"WITH {STEPS} SELECT round(sum(pos * tp / (tp + fp)) / max(all_pos), 8) AS average_precision FROM st",
)
def average_precision(spark, folder):
    out = metrics.average_precision(metrics.score_steps(scored(spark, folder), "y", "score"))
    return out.select(F.round("average_precision", 8).alias("average_precision"))


_SWEEP = f"""
    WITH {SCORED}, t AS (SELECT unnest(range(1, 100)) / 100.0::DOUBLE AS threshold),
    c AS (SELECT threshold, count(*) FILTER (WHERE y = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE y <> 1 AND score >= threshold) AS fp,
      count(*) FILTER (WHERE y = 1 AND score < threshold) AS fn, count(*) FILTER (WHERE y <> 1 AND score < threshold) AS tn FROM sc, t GROUP BY 1),
    {_RATES}, f AS (SELECT *, 2 * p * r / greatest(p + r, 1e-12) AS f1 FROM m)
"""


@query(
    "threshold_sweep",
    "E06",
    f"{_SWEEP} SELECT threshold, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f",
)
def threshold_sweep(spark, folder):
    out = metrics.threshold_sweep(scored(spark, folder), "y", "score")
    return out.select("threshold", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("best_threshold", "E06", f"{_SWEEP} SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, threshold LIMIT 1")
def best_threshold(spark, folder):
    best = metrics.best_threshold(metrics.threshold_sweep(scored(spark, folder), "y", "score"))
    return best.select("threshold", F.round("f1", 6).alias("f1"))


def guessed(spark, folder):
    """A simple rule as classifier: return flag guessed from the ship year and the discount."""
    guess = F.when(F.year("l_shipdate") < 1997, "A").when(F.col("l_discount") >= 0.05, "N").otherwise("R")
    return table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("actual"), guess.alias("predicted"))


GUESSED = """g AS (SELECT l_returnflag AS actual, CASE WHEN year(l_shipdate) < 1997 THEN 'A' WHEN l_discount >= 0.05 THEN 'N' ELSE 'R' END AS predicted FROM lineitem)"""
_REPORT = f"""{GUESSED}, c AS (SELECT actual, predicted, count(*) AS n FROM g GROUP BY 1, 2),
    s AS (SELECT actual AS class, n AS support, 0 AS guesses, CASE WHEN actual = predicted THEN n ELSE 0 END AS hits FROM c
      UNION ALL SELECT predicted, 0, n, 0 FROM c),
    k AS (SELECT class, CAST(sum(support) AS BIGINT) AS support, sum(guesses) AS guesses, sum(hits) AS hits FROM s GROUP BY 1),
    rep AS (SELECT class, support, coalesce(hits / nullif(guesses, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
      coalesce(2 * hits / nullif(support + guesses, 0), 0) AS f1, hits FROM k)"""


@query(
    "contingency_table",
    "A14",
    f"""WITH {GUESSED}, c AS (SELECT actual, predicted, count(*) AS n FROM g GROUP BY 1, 2),
    l AS (SELECT actual AS c FROM c UNION SELECT predicted FROM c),
    f AS (SELECT a.c AS actual, b.c AS predicted, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.actual = a.c AND c.predicted = b.c)
    SELECT actual, predicted, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 0), 6) AS share FROM f""",
)
def contingency_table(spark, folder):
    return metrics.contingency(guessed(spark, folder), "actual", "predicted").withColumn("share", F.round("share", 6))


@query(
    "class_report",
    "E08",
    f"WITH {_REPORT} SELECT class, support, round(precision, 3) AS precision, round(recall, 3) AS recall, round(f1, 3) AS f1 FROM rep",
)
def class_report(spark, folder):
    out = metrics.class_report(guessed(spark, folder), "actual", "predicted")
    return out.select("class", "support", *[F.round(c, 3).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "classification_scores",
    "E07",
    f"WITH {_REPORT} SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM rep",
)
def classification_scores(spark, folder):
    out = metrics.classification_scores(guessed(spark, folder), "actual", "predicted")
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def predicted_prices(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 2100.0).alias("predicted"), "l_orderkey"
    )


@query(
    "regression_report",
    "E09",
    """
    WITH p AS (SELECT l_returnflag, l_extendedprice AS a, l_quantity * 2100.0::DOUBLE AS p FROM lineitem)
    SELECT l_returnflag, round(1 - avg((a - p) ** 2) / var_pop(a), 6) AS r2, round(sqrt(avg((a - p) ** 2)), 3) AS rmse,
      round(avg(abs(a - p)), 3) AS mae, round(avg((a - p) ** 2) / 1e6, 4) AS mse FROM p GROUP BY 1
    """,
)
def regression_report(spark, folder):
    out = metrics.regression_report(predicted_prices(spark, folder), "actual", "predicted", ["l_returnflag"])
    return out.select(
        "l_returnflag", F.round("r2", 6).alias("r2"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"),
        F.round(F.col("mse") / 1e6, 4).alias("mse"),
    )


@query(
    "residual_table",
    "E10",
    f"SELECT l_orderkey, {settled_sql('l_quantity * 2100.0', 2)} AS predicted, {settled_sql('l_extendedprice - l_quantity * 2100.0', 2)} AS residual FROM lineitem",
)
def residual_table(spark, folder):
    out = metrics.residuals(predicted_prices(spark, folder), "actual", "predicted")
    return out.select("l_orderkey", settled("predicted", 2), settled("residual", 2))
