"""Ranks, running totals and quantiles with a hot key agree with plain computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismill.operators import ordering as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    key = np.where(np.arange(3000) % 3 == 0, "hot", rng.choice(list("abc"), 3000))
    pdf = pd.DataFrame({"id": np.arange(3000), "key": key, "value": np.round(rng.normal(size=3000), 2)})
    pdf.loc[::10, "value"] = 1.5
    return pdf, spark.createDataFrame(pdf).repartition(8)


def test_running_sum_and_max(rows):
    pdf, df = rows
    got = O.running(df, ["key"], ["value", "id"], {"s": F.col("id")}).toPandas().sort_values("id")
    want = pdf.sort_values(["key", "value", "id"]).groupby("key")["id"].cumsum().sort_index()
    assert (got["s"].to_numpy() == want.to_numpy()).all()
    got = O.running(df, ["key"], ["id"], {"m": F.col("value")}, how="max").toPandas().sort_values("id")
    want = pdf.groupby("key")["value"].cummax()
    assert (got["m"].to_numpy() == want.to_numpy()).all()


def test_rank_with_null_key(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("a", i) for i in range(50)], "k string, i int")
    got = O.ranked(df, ["k"], ["i"]).where(F.col("rank") != F.col("i") + 1)
    assert got.count() == 0 and O.ranked(df, ["k"], ["i"]).count() == 100


def test_shuffled_rank_is_a_permutation(rows):
    _, df = rows
    got = O.shuffled_rank(df, ["key"], "id").groupBy("key").agg(
        F.count_distinct("rank").alias("d"), F.max("rank").alias("m"), F.count("*").alias("n")
    )
    assert got.where("d <> n OR m <> n").count() == 0


def test_quantiles(rows):
    pdf, df = rows
    got = O.exact_quantiles(df, "value", {"a": 0.1, "m": 0.5, "z": 0.99}, ["key"]).toPandas().set_index("key").sort_index()
    want = pdf.groupby("key")["value"].quantile([0.1, 0.5, 0.99]).unstack()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy())


def test_mode_and_first(spark):
    df = spark.createDataFrame([(2.0,), (1.0,), (2.0,), (1.0,), (None,)], "v double")
    assert O.most_frequent(df, "v").collect() == [(1.0, 2)]
    df = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("w", 5, "c")], "k string, o int, x string")
    assert sorted(tuple(r) for r in O.first_per_key(df, ["k"], ["o"]).collect()) == [("u", 1, "a"), ("w", 5, "c")]


def test_every_kth(spark):
    got = [r["id"] for r in O.every_kth(spark.range(23), ["id"], 5).orderBy("id").collect()]
    assert got == list(range(0, 23, 4))
