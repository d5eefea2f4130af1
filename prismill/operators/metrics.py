"""Evaluation of predictions: counts and curves by aggregates over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismill.operators.forecasting import regression_scores
from prismill.operators.ordering import running

# The thresholds a sweep tries, .01 to .99.
THRESHOLDS = tuple(i / 100 for i in range(1, 100))


def binary_confusion(df: DataFrame, truth: str, score: str, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """Counts of the four outcomes when scores at or above the threshold count as positive."""
    hit, real = F.col(score) >= threshold, F.col(truth) == 1
    return df.groupBy(*(keys or [])).agg(
        F.count_if(real & hit).alias("tp"),
        F.count_if(~real & hit).alias("fp"),
        F.count_if(real & ~hit).alias("fn"),
        F.count_if(~real & ~hit).alias("tn"),
    )


def _ratio(top: Column, bottom: Column, floor: float = 1.0) -> Column:
    return top / F.greatest(bottom, F.lit(floor))


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """Rates from confusion counts; empty denominators count as 1 (F1: 1e-12)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    out = counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, n),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "specificity": _ratio(tn, tn + fp),
            "base_rate": _ratio(tp + fn, n),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns(
        {
            "f1": _ratio(2 * p * r, p + r, 1e-12),
            "balanced_accuracy": (r + F.col("specificity")) / 2,
            "majority_accuracy": F.greatest(F.col("base_rate"), 1 - F.col("base_rate")),
        }
    )


def score_steps(df: DataFrame, truth: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Per distinct score, from the highest down: own and cumulative positives and negatives, and totals."""
    keys = keys or []
    steps = (
        df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
        .groupBy(*keys, F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
        .withColumn("_down", -F.col("threshold"))
    )
    placed = running(steps, keys, ["_down"], {"tp": F.col("pos"), "fp": F.col("neg")}, grand=True)
    return placed.drop("_down").withColumnsRenamed({"all_tp": "all_pos", "all_fp": "all_neg"})


def roc_curve(steps: DataFrame) -> DataFrame:
    return steps.withColumns(
        {"fpr": F.try_divide("fp", "all_neg"), "tpr": F.try_divide("tp", "all_pos")}
    ).select(*[c for c in steps.columns if c not in ("pos", "neg", "all_pos", "all_neg")], "fpr", "tpr")


def roc_auc(steps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve per key, null when a key has one class only."""
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    pairs = F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
    return steps.groupBy(*(keys or [])).agg(F.try_divide(F.sum(area), pairs).alias("auc"))


def macro_auc(per_class: DataFrame) -> DataFrame:
    """Mean of one-against-rest areas; null when any class has no area."""
    return per_class.agg(F.when(F.count("auc") == F.count("*"), F.avg("auc")).alias("auc"))


def precision_recall_curve(steps: DataFrame) -> DataFrame:
    return steps.withColumns(
        {"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", "all_pos")}
    ).select(*[c for c in steps.columns if c not in ("pos", "neg", "all_pos", "all_neg")], "precision", "recall")


def average_precision(steps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Precision at each step weighted by the recall gained there."""
    gained = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return steps.groupBy(*(keys or [])).agg(F.try_divide(F.sum(gained), F.max("all_pos")).alias("average_precision"))


def threshold_sweep(df: DataFrame, truth: str, score: str, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Metrics at every threshold from one aggregate over the score bands between thresholds."""
    cuts = F.array(*[F.lit(t) for t in thresholds])
    band = F.size(F.filter(cuts, lambda t: F.col(score) >= t))
    bands = df.groupBy(band.alias("band")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")
    )
    # at most one row per threshold from here on
    above = F.explode(F.sequence(F.lit(1), F.lit(len(thresholds))))
    per = bands.select("band", "pos", "neg", above.alias("i")).groupBy("i").agg(
        F.sum(F.when(F.col("band") >= F.col("i"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("band") >= F.col("i"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("band") < F.col("i"), F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("band") < F.col("i"), F.col("neg")).otherwise(0)).alias("tn"),
    )
    return confusion_metrics(per).withColumn("threshold", F.element_at(cuts, F.col("i"))).drop("i")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold with the best F1."""
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("t")))
    return sweep.agg(best.alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def contingency(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts of every actual-predicted pair, zero cells included, and the share within the actual class."""
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    both = counts.select(F.col("actual").alias("c")).union(counts.select("predicted")).where("c IS NOT NULL")
    # class names only: one array value per distinct class
    names = both.agg(F.collect_set("c")).scalar()
    cells = both.distinct().withColumn("_all", names).select(F.col("c").alias("actual"), F.explode("_all").alias("predicted"))
    full = cells.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    whole = F.sum("n").over(Window.partitionBy("actual"))
    return full.withColumn("share", F.coalesce(F.try_divide(F.col("n"), whole), F.lit(0.0)))


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every class seen on either side; empty denominators give 0."""
    counts = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guesses"),
                         F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guesses"),
                         F.lit(0).cast("bigint").alias("hits")),
            )
        )
    )
    rows = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "guesses", "hits")])
    zero = F.lit(0.0)
    return rows.select(
        "class", "support",
        F.coalesce(F.try_divide("hits", "guesses"), zero).alias("precision"),
        F.coalesce(F.try_divide("hits", "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("guesses")), zero).alias("f1"),
    )


def classification_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and F1 averaged over classes."""
    report = class_report(df, actual, predicted).withColumn("hits", F.col("recall") * F.col("support"))
    return report.agg((F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def regression_report(df: DataFrame, actual: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    scores = regression_scores(F.col(actual), F.col(predicted))
    mse = F.avg((F.col(actual) - F.col(predicted)) ** 2).alias("mse")
    return df.groupBy(*(keys or [])).agg(*scores, mse)


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))
