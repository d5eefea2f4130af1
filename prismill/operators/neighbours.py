"""Classifiers without an MLlib counterpart: nearest neighbours and Gaussian naive Bayes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismill.operators.blocks import each_block_pair, matrix, squared_distances


def nearest(
    train: DataFrame, queries: DataFrame, row_id: str, vector: str, label: str, k: int = 5
) -> DataFrame:
    """The k nearest training rows of every query: k per block first, then k of those."""
    left = queries.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    right = train.select(F.col(row_id).alias("tid"), F.col(vector).cast("array<double>").alias("v"))

    def closest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(x["v"]), matrix(y["v"])
        d = squared_distances(a, b)
        take = min(k, d.shape[1])
        rank = np.lexsort((np.broadcast_to(y["tid"].to_numpy(), d.shape), d), axis=1)[:, :take]
        exact = np.sqrt(((a[:, None, :] - b[rank]) ** 2).sum(axis=2))
        return pd.DataFrame(
            {"id": np.repeat(x["id"].to_numpy(), take), "tid": y["tid"].to_numpy()[rank].ravel(), "distance": exact.ravel()}
        )

    def closest_of(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["id", "distance", "tid"]).groupby("id").head(k)

    partial = each_block_pair(left, right, "id", "tid", closest, "id bigint, tid bigint, distance double", merge=closest_of)
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "tid"))
    best = partial.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(train.select(F.col(row_id).alias("tid"), F.col(label).cast("string").alias("label")), "tid")


def knn_classify(
    train: DataFrame, queries: DataFrame, row_id: str, vector: str, label: str, k: int = 5, weights: str = "uniform"
) -> DataFrame:
    """Vote of the nearest rows, equal or by inverse distance; the smallest label wins a tie."""
    found = nearest(train, queries, row_id, vector, label, k)
    if weights == "uniform":
        vote = F.lit(1.0)
    else:
        hit = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("id")) == 1
        vote = F.when(hit, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))
    votes = found.withColumn("_w", vote).groupBy("id", "label").agg(F.sum("_w").alias("w"))
    best = F.min(F.struct((-F.round("w", 12)).alias("w"), "label"))
    return votes.groupBy(F.col("id").alias(row_id)).agg(best.alias("b")).select(row_id, F.col("b.label").alias("predicted"))


def fit_naive_bayes(train: DataFrame, columns: list[str], label: str, var_smoothing: float = 1e-9) -> list[tuple]:
    """Per class: log prior, means and floored variances; classes times columns numbers in all."""
    widest = train.agg(F.greatest(*[F.var_pop(c) for c in columns], F.lit(0.0)).alias("v")).first()["v"]
    rows = train.groupBy(label).agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in columns]).alias("m"), F.array(*[F.var_pop(c) for c in columns]).alias("v")
    ).orderBy(label).collect()
    total = sum(r["n"] for r in rows)
    floor = var_smoothing * widest
    return [(r[label], math.log(r["n"] / total), list(r["m"]), [v + floor for v in r["v"]]) for r in rows]


def naive_bayes_classify(df: DataFrame, columns: list[str], model: list[tuple], out: str = "predicted") -> DataFrame:
    """Most likely class of each row, a projection over the fitted numbers."""
    options = []
    for place, (name, prior, means, variances) in enumerate(model):
        score = F.lit(prior)
        for c, m, v in zip(columns, means, variances):
            score = score - F.lit(0.5 * math.log(2 * math.pi * v)) - (F.col(c) - F.lit(m)) ** 2 / F.lit(2 * v)
        options.append(F.struct(score.alias("s"), F.lit(-place).alias("p"), F.lit(name).alias("c")))
    return df.withColumn(out, F.array_max(F.array(*options)).getField("c"))
