"""Preparation, models, explanations, clusters and topics against closed forms or brute force."""

import os
import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Estimator
from pyspark.sql import functions as F

from prismill.operators import blocks, clustering as K, explain as X, models as M, neighbours as N
from prismill.operators import preprocess as P, profile, splits, topics as T, validation as V, words as W
from prismill.operators.runs import RunLog, setting_text, which_settings_matter


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(0)
    n = 300
    pdf = pd.DataFrame({
        "row_id": np.arange(n), "age": rng.integers(20, 70, n).astype(float), "income": rng.normal(500, 150, n),
        "job": rng.choice(["a", "b", "c"], n), "city": rng.choice([f"c{i:02d}" for i in range(40)], n)})
    pdf["bought"] = np.where(pdf["income"] + 60 * (pdf["job"] == "a") + rng.normal(0, 60, n) > 510, "yes", "no")
    pdf["spent"] = 3 * pdf["age"] + 0.2 * pdf["income"] + rng.normal(size=n)
    pdf.loc[::11, "income"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("income", F.nanvl("income", F.lit(None)))
    return pdf, df.persist()


def test_infer_task(spark):
    cases = {"letters": (["a", "b"], "classification"), "ints": ([1, 2, 3, 4, 5], "classification"), "reals": (np.random.rand(30).tolist(), "regression"),
             "many": (list(range(200)), "regression"), "two": ([0.5, 1.5, 0.5], "classification")}
    for name, (values, want) in cases.items():
        df = spark.createDataFrame([(v,) for v in values], [name])
        assert profile.infer_task(df, name).first()["task"] == want, name
    assert profile.infer_task(spark.createDataFrame([], "x double"), "x").first()["task"] == "regression"


def test_preprocessing_learns_from_the_training_part_only(mixed):
    _, df = mixed
    train = df.where("row_id < 200")
    model = P.Preprocessor(["age", "income"], ["job", "city"]).fit(train)
    a = model.transform(train).count()
    shifted = df.where("row_id >= 200").withColumn("income", F.col("income") + 1e6)
    model.transform(shifted).count()
    values = train.select("income").toPandas()["income"]
    assert a == 200 and model.fills["income"] == pytest.approx(values.median())
    assert model.moments["age"][1] == pytest.approx(train.toPandas()["age"].std(ddof=0))


def test_onehot_limits(spark):
    rows = [(f"l{i:02d}",) for i in range(40) for _ in range(i + 2)] + [("once",)]
    df = spark.createDataFrame(rows, "c string")
    levels, rare = P.onehot_levels(df, "c")
    assert len(levels) + rare == 30 and rare and "l39" in levels and "l00" not in levels
    columns = P.onehot_columns("c", levels, rare)
    unknown = spark.createDataFrame([("new",)], "c string").select(*[c.alias(n) for n, c in columns.items()]).first()
    assert unknown["c_infrequent"] == 1.0 and sum(unknown) == 1.0
    small = spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "c string")
    columns = P.onehot_columns("c", *P.onehot_levels(small, "c"))
    assert sum(spark.createDataFrame([("new",)], "c string").select(*[c.alias(n) for n, c in columns.items()]).first()) == 0


def test_ridge_and_lasso_match_their_objectives(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    y = 50 * x[:, 0] - 20 * x[:, 1] + 7 + rng.normal(size=80)
    df = K.vectors(spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": y})), ["a", "b"])
    facts = M.training_facts(df, M.REGRESSION)
    for alpha in (1.0, 30.0):
        model = M.ridge(facts, alpha).fit(df)
        xc, yc = x - x.mean(axis=0), y - y.mean()
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
        np.testing.assert_allclose(model.coefficients.toArray(), want, rtol=1e-6)
    one = K.vectors(df.drop("features"), ["a"])
    xc = x[:, 0] - x[:, 0].mean()
    slope, alpha = xc @ (y - y.mean()) / 80, 3.0
    want = np.sign(slope) * max(abs(slope) - alpha, 0) / (xc @ xc / 80)
    got = M.lasso(facts, alpha).fit(one).coefficients.toArray()[0]
    assert got == pytest.approx(want, rel=1e-4)


def test_models_beat_the_baseline(mixed):
    _, df = mixed
    options = {"forest": {"n_estimators": 20, "max_depth": 5}}
    scores = V.cross_validate_models(["linear", "forest", "baseline"], df, "row_id", M.CLASSIFICATION, "bought", ["age", "income"], ["job"], splits=3, options=options)
    table = {r["model"]: r for r in V.compare_scores(scores).collect()}
    assert table["linear"]["gain"] > 0.1 and table["forest"]["gain"] > 0.1 and table["baseline"]["gain"] == 0


def test_explanations(mixed, spark):
    _, df = mixed
    pipeline = M.TabularPipeline("forest", M.REGRESSION, "spent", ["age", "income"], [], options={"n_estimators": 20, "max_depth": 6})
    noisy = X.with_noise(df, "row_id", 1)
    pipeline.numeric = ["age", "income", "noise_1"]
    model = pipeline.fit(noisy)
    lost = {r["feature"]: r["drop"] for r in X.permutation_importance(model, noisy, pipeline.numeric, "row_id", 2).collect()}
    assert max(lost, key=lost.get) == "age" and lost["noise_1"] < 0.1
    own = X.model_importance(model, spark).collect()
    assert own[0]["feature"] == "age" and sum(r["importance"] for r in own) == pytest.approx(1)
    shares = X.contributions(model, noisy, "row_id", max_samples=10, permutations=8).persist()
    sums = shares.groupBy("row_id").agg(F.sum("contribution").alias("s"), F.first("base").alias("b"), F.first("prediction").alias("p"))
    assert all(r["s"] == pytest.approx(r["p"] - r["b"], abs=1e-6) for r in sums.collect())
    top = X.top_contributions(shares, "row_id", 1).groupBy("row_id").agg(F.sum("contribution").alias("s"))
    assert all(a["s"] == pytest.approx(b["s"], abs=1e-9) for a, b in zip(top.orderBy("row_id").collect(), sums.orderBy("row_id").collect()))


@pytest.mark.parametrize("key", ["logreg", "knn", "svm_linear", "svm_rbf", "tree", "gbdt", "gnb"])
def test_classifiers_separate_blobs(spark, key):
    rng = np.random.default_rng(0)
    label = np.arange(160) % 2
    x = rng.normal(size=(160, 2)) + 4 * label[:, None]
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(160), "a": x[:, 0], "b": x[:, 1], "label": label.astype(float)}))
    params = {"gbdt": {"n_estimators": 5}, "svm_rbf": {"gamma": 0.5}}.get(key)
    model = M.fit_classifier(key, df.where("row_id < 100"), ["a", "b"], params)
    assert V.accuracy(model.transform(df.where("row_id >= 100"))) > 0.9


def test_polynomial_degree(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, 120)
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(120), "x": x, "y": x**2 + 0.05 * rng.normal(size=120)}))
    sweep = V.degree_sweep(df.where("row_id < 80"), df.where("row_id >= 80"), "x", "y", "row_id", (1, 2))
    assert V.best_degree(sweep).first()["degree"] == 2
    assert V.polynomial_errors(df, df, "x", "y", 3, "lasso", 10.0)["zero_coefficients"] == 3


def test_splits(spark):
    df = spark.range(100).withColumn("y", F.when(F.col("id") % 10 == 0, "rare").otherwise("often"))
    parts = splits.hold_out(df, "id", "y").groupBy("y", "part").count().collect()
    assert {(r["y"], r["part"]): r["count"] for r in parts} == {("rare", "train"): 7, ("rare", "test"): 3, ("often", "train"): 63, ("often", "test"): 27}
    folds = splits.shuffled_folds(df, "id", 5, "y").groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("y") == "rare").alias("r")).collect()
    assert {(r["n"], r["r"]) for r in folds} == {(20, 2)}
    lonely = df.withColumn("y", F.when(F.col("id") == 3, "one").otherwise("rest"))
    assert splits.hold_out(lonely, "id", "y").where("part = 'train'").count() == 70


def test_blocks_cover_every_pair(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    c = np.arange(60) % 3
    x += 3 * c[:, None]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(60), "v": list(x), "c": c}))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i in range(60):
        means = [d[i, c == k].sum() / ((c == k).sum() - (k == c[i])) for k in range(3)]
        a, b = means[c[i]], min(m for k, m in enumerate(means) if k != c[i])
        want.append((b - a) / max(a, b))
    old, blocks.each_block_pair.__defaults__ = blocks.each_block_pair.__defaults__, (7,)
    try:
        got = K.silhouette_points(df, "id", "v", "c").orderBy("id").toPandas()["silhouette"]
        votes = N.nearest(df.where("id < 40"), df.where("id >= 40"), "id", "v", "c", 4).orderBy("id", "rank").toPandas()
    finally:
        blocks.each_block_pair.__defaults__ = old
    np.testing.assert_allclose(got, want, atol=1e-9)
    for i, part in votes.groupby("id"):
        assert list(part["tid"]) == list(np.argsort(d[i, :40], kind="stable")[:4])


def test_blocks_grow_with_the_table(spark):
    """A row is sent once per block of the other side, so their number must not follow the rows; blocks are worked through tile by tile."""
    assert all(blocks._block_count(spark.range(n), 10) <= 13 for n in (600, 1200, 1900))
    x = np.random.default_rng(3).normal(size=(200, 3))
    c = np.arange(200) % 3
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "v": list(x), "c": c}))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    means = np.stack([d[:, c == k].sum(axis=1) / ((c == k).sum() - (c == k)) for k in range(3)], axis=1)
    a, b = means[np.arange(200), c], np.where(np.arange(3) == c[:, None], np.inf, means).min(axis=1)
    old, blocks.each_block_pair.__defaults__ = blocks.each_block_pair.__defaults__, (3,)
    try:
        got = K.silhouette_points(df, "id", "v", "c").orderBy("id").toPandas()["silhouette"]
        votes = N.nearest(df, df, "id", "v", "c", 4).orderBy("id", "rank").toPandas()
    finally:
        blocks.each_block_pair.__defaults__ = old
    np.testing.assert_allclose(got, (b - a) / np.maximum(a, b), atol=1e-9)
    for i, part in votes.groupby("id"):
        assert list(part["tid"]) == list(np.argsort(d[i], kind="stable")[:4])


def brute_density(x, y, eps, least):
    near = (x[:, None] - x[None]) ** 2 + (y[:, None] - y[None]) ** 2 <= eps * eps
    core = near.sum(axis=1) >= least
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], i
            while stack:
                j = stack.pop()
                for k in np.flatnonzero(near[j] & core & (label < 0)):
                    label[k] = i
                    stack.append(k)
    for i in np.flatnonzero(~core):
        mates = label[near[i] & core]
        label[i] = mates.min() if len(mates) else -1
    return core, label


@pytest.mark.parametrize("seed", [0, 1])
def test_density_clusters_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    spread = np.concatenate([rng.normal(size=(80, 2)) * 2, rng.uniform(-8, 8, (120, 2)), np.tile([[5.0, 5.0]], (60, 1)), rng.normal(size=(80, 2)) * 0.2 + 4])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(spread)), "x": spread[:, 0], "y": spread[:, 1]}))
    got = K.dbscan(df, "id", "x", "y", 0.7, 5).orderBy("id").toPandas()
    core, label = brute_density(spread[:, 0], spread[:, 1], 0.7, 5)
    assert (got["core"].to_numpy() == core).all()
    assert (got["cluster"].to_numpy() == label).all()


def test_components_of_a_grid_settle_in_few_rounds(spark):
    side = 30
    name = lambda i, j: (i * side + j) * 7919 % 9973
    cells = [(i, j) for i in range(side) for j in range(side) if i != 11]  # a row left out: two components
    near = [(name(i, j), name(k, m)) for i, j in cells for k, m in ((i + 1, j), (i, j + 1)) if (k, m) in set(cells)]
    nodes = spark.createDataFrame([(name(*c), name(*c)) for c in cells], "node long, label long")
    edges = spark.createDataFrame(near + [(b, a) for a, b in near], "a long, b long")
    found = {r["node"]: r["label"] for r in K.connected_components(nodes, edges, max_rounds=10).collect()}
    least = [min(name(*c) for c in cells if (c[0] > 11) == after) for after in (False, True)]
    assert found == {name(i, j): least[i > 11] for i, j in cells}


def test_a_classifier_works_its_rows_out_few_times(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(i, float(i % 3), float(i % 3) + i / 100, i / 7) for i in range(60)], "row_id long, label double, a double, b double")
    rows = rows.coalesce(1).mapInPandas(counted, "row_id long, label double, a double, b double")
    model = M.fit_classifier("svm_linear", rows, ["a", "b"])
    assert seen.value <= 3 * 60 and model.transform(rows).count() == 60


class Fitted(Exception):
    pass


class Counts(Estimator):
    """Tells in how many tasks an estimator finds rows."""

    def _fit(self, df):
        raise Fitted(df.select(F.spark_partition_id()).distinct().count())


def test_rows_of_one_file_are_dealt_over_tasks_for_a_fit(spark, monkeypatch):
    rows = spark.range(20_000).coalesce(1).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 7).alias("a"))
    monkeypatch.setitem(M.CLASSIFIERS, "tree", M.ModelSpec("tree", lambda facts, seed: Counts(), False))
    monkeypatch.setitem(M.TABULAR, "forest", (True, lambda f, s: Counts(), None))
    with pytest.raises(Fitted, match="^4$"):
        M.fit_classifier("tree", rows, ["a"])
    with pytest.raises(Fitted, match="^4$"):
        M.TabularPipeline("forest", M.CLASSIFICATION, "label", ["a"], []).fit(rows)


def test_degree_sweep_works_its_rows_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(i, i / 40, (i / 40) ** 2 - i % 3) for i in range(40)], "row_id long, x double, y double")
    rows = rows.coalesce(1).mapInPandas(counted, "row_id long, x double, y double")
    swept = V.degree_sweep(rows.where("row_id % 4 > 0"), rows.where("row_id % 4 = 0"), "x", "y", "row_id", degrees=[1, 2]).collect()
    assert seen.value <= 80 and swept[1]["train_mse"] < swept[0]["train_mse"]


def test_kmeans_history(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2)) + 6 * (np.arange(200) % 3)[:, None]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "x": x[:, 0], "y": x[:, 1]}))
    for init in ("k-means++", "random"):
        rounds = K.kmeans_rounds(df, ["x", "y"], 3, "id", init=init, seed=2).where("cluster = 0").orderBy("iteration").toPandas()
        assert (rounds["inertia"].diff().dropna() <= 1e-9).all() and rounds["shift"].iloc[-1] < 1e-6
    first = K.kmeans_rounds(df, ["x", "y"], 2, "id", start=[[0.0, 0.0], [1e6, 1e6]], max_iter=1).where("cluster = 1").first()
    farthest = max(map(tuple, x.tolist()), key=lambda p: p[0] ** 2 + p[1] ** 2)
    assert first["n"] == 0 and (first["to_x"], first["to_y"]) == pytest.approx(farthest)


DOCS = ["team wins final match goal", "player scores goal match team", "team coach praises player match", "final match draws crowd team",
        "market prices rise bank", "bank raises market rates prices", "prices fall market trade", "trade bank reports market growth"]


def test_text(spark):
    df = spark.createDataFrame([(i, d, "sport" if i < 4 else "economy") for i, d in enumerate(DOCS)], "doc_id int, text string, label string")
    terms = W.term_rows(df)
    weights = W.tfidf(df, terms, min_df=2, max_df=0.6)
    norms = weights.groupBy("doc_id").agg(F.sum(F.col("tfidf") ** 2).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1) for r in norms)
    found = T.vectorise(df, min_df=2, max_df=0.6)
    assert found.terms == sorted(r["term"] for r in weights.select("term").distinct().collect())
    components, mixes, losses = T.fit_nmf(found, "doc_id", 2, iterations=30)
    assert all(a >= b - 1e-9 for a, b in zip(losses, losses[1:]))
    lead = [r["topic"] for r in T.dominant_topics(mixes, "doc_id").orderBy("doc_id").collect()]
    assert len(set(lead[:4])) == 1 and len(set(lead[4:])) == 1 and lead[0] != lead[-1]
    out = T.classify_documents(found, "doc_id", "label", 2)
    assert out.where("actual = predicted").count() >= 6
    best = T.class_words(found, "doc_id", "label", 2)
    assert {r["class"] for r in best.collect()} == {"sport", "economy"}
    nodes, edges = W.cooccurrence(terms, top=10, min_together=2)
    assert all(r["left_term"] < r["right_term"] for r in edges.collect()) and nodes.count() == 10


def test_terms_leave_in_parts(spark):
    """What a task holds of its terms is bounded, however many documents come in one batch."""
    import pyarrow as pa

    texts = [" ".join("".join(chr(97 + (i + 7 * d) // 26**j % 26) for j in range(4)) for i in range(9000)) for d in range(30)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(32)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(W._counted(["doc_id"], 2, frozenset())(iter([batch])))
    assert max(map(len, parts)) < W.TERM_ROWS + 9000 and len(parts) > 3
    assert sum(sum(p.column("tf").to_pylist()) for p in parts) == 30 * 9000
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert W.term_rows(rows, stop_words=[]).count() == sum(map(len, parts))


def test_run_log(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    assert log.load_runs().count() == 0
    with pytest.raises(ValueError):
        log.log("  ", "lab")
    ids = [log.log("trial", "lab8", {"depth": d, "model": m}, {"score": s}) for d, m, s in ((3, "a", 0.5), (6, "a", 0.7), (3, "b", 0.6))]
    log.log("other/one", "lab9", {}, {"score": "bad"})
    assert log.load_runs().count() == 4
    rows = {r["setting"]: r for r in which_settings_matter(log.runs_of("trial"), "score").collect()}
    assert rows["depth"]["best_value"] == "6" and rows["depth"]["spread"] == pytest.approx(0.15)
    assert log.delete_run(ids[0]) and not log.delete_run("nope")
    assert log.runs_of("trial").count() == 2
    assert log.delete_experiment("other/one") == 1 and log.delete_experiment("other/one") == 0
    assert log.delete_run(ids[1]) and log.delete_run(ids[2]) and log.load_runs().count() == 0
    log.clear_all()


@pytest.mark.parametrize("value,text", [(True, "はい"), (False, "いいえ"), (3, "3"), (0.123456789, "0.123457"), ("x", "x"), ([1, 2], "1、2"), ((0.5, "a"), "0.5、a")])
def test_setting_text(value, text):
    assert setting_text(value) == text


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_registered_contributions_explain_every_row(spark):
    from prismill.plans.learning import lines
    from prismill.plans.registry import QUERIES

    shown = QUERIES["top_contributions"](spark, "/root/testdata/sf0.001").select("row_id").distinct().count()
    assert shown == lines(spark, "/root/testdata/sf0.001").select("row_id").distinct().count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_registered_fits_keep_the_operators_settings(spark, monkeypatch):
    from prismill.operators import forecasting
    from prismill.plans import learning, timeseries, topics  # noqa: F401
    from prismill.plans.registry import QUERIES

    seen = {}

    def note(name, out):
        return lambda *args, **options: seen.update({name: (args, options)}) or out

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(V, "compare_scores", lambda scores: scores)
    monkeypatch.setattr(V, "cross_validate_models", note("folds", None))
    monkeypatch.setattr(V, "ensemble_stages", note("stages", None))
    monkeypatch.setattr(forecasting, "boosted_predictions", note("boosted", None))
    monkeypatch.setattr(forecasting, "score_predictions", lambda *args: None)
    for name in ("cross_validated_models", "ensemble_stages", "backtest_boosted"):
        QUERIES[name](spark, folder)
    assert not {k for _, options in seen.values() for k in options} and len(seen) == 3
    assert QUERIES["singular_values"](spark, folder).count() == 50


def test_a_linear_svm_reaches_its_optimum(spark):
    """Stopped after 30 rounds it was 1.3e-4 above the optimum."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(400, 40)) * np.geomspace(1, 30, 40), (rng.random(400) < 0.3).astype(float)
    df = K.vectors(spark.createDataFrame(pd.DataFrame({f"x{j}": x[:, j] for j in range(40)} | {"label": y})).coalesce(1), [f"x{j}" for j in range(40)])
    fitted = M.linear_svm(M.training_facts(df, M.CLASSIFICATION)).fit(df)
    sign, a, still = 2 * y - 1, np.column_stack([x, np.ones(400)]), np.diag([1.0] * 40 + [0.0]) / 400
    w = np.zeros(41)
    for bend in np.geomspace(1, 1e-4, 9):  # hinges bent ever less, each to the end by Newton steps
        loss = lambda v: v @ still @ v / 2 + np.where((m := 1 - sign * (a @ v)) < bend, np.maximum(m, 0) ** 2 / bend / 2, m - bend / 2).mean()  # noqa: E731, B023
        for _ in range(100):
            m = 1 - sign * (a @ w)
            inside = (m > 0) & (m < bend)
            g = still @ w - a.T @ (sign * np.clip(m / bend, 0, 1)) / 400
            step, size = np.linalg.solve(still + a[inside].T @ a[inside] / bend / 400 + 1e-12 * np.eye(41), g), 1.0
            while loss(w - size * step) > loss(w) and size > 1e-9:
                size /= 2
            w = w - size * step
    exact = lambda v: v @ still @ v / 2 + np.maximum(1 - sign * (a @ v), 0).mean()
    assert exact(np.append(fitted.coefficients.toArray(), fitted.intercept)) < exact(w) + 1e-5


def test_a_hold_out_in_place_is_the_ranked_one(spark):
    """The same parts without an exchange of the rows; rows without an id and rows that come twice included."""
    rows = [(None if i % 11 == 0 else i, "rare" if i % 10 == 3 else None if i % 17 == 5 else "often", i * 0.5) for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:500], "id long, y string, x double")
    sides = []
    for how in (splits.hold_out, splits.hold_out_in_place):
        placed = how(df, "id", "y")
        assert placed.columns == ["id", "y", "x", "part"]
        counts = {(r["y"], r["part"]): r["count"] for r in placed.groupBy("y", "part").count().collect()}
        known = placed.where("id IS NOT NULL").groupBy("id", "y", "x", "part").count().collect()
        sides.append((counts, sorted(map(str, known))))
    assert sides[0] == sides[1]
    assert splits.hold_out_in_place(df.limit(0), "id", "y").count() == 0
    lonely = spark.range(100).withColumn("y", F.when(F.col("id") == 3, "one").otherwise("rest"))
    assert splits.hold_out_in_place(lonely, "id", "y").where("part = 'train'").count() == 70


def test_models_of_one_split_share_their_rows(spark, monkeypatch):
    """Four fits: the rows were prepared, checkpointed with all their columns and dealt for each of them."""
    stored, dealt = [], []
    plain = M.dealt
    monkeypatch.setattr(M, "cut_lineage", lambda df: stored.append(df.columns) or df)
    monkeypatch.setattr(M, "dealt", lambda df, rows: dealt.append(df.columns) or plain(df, rows))
    df = spark.range(400).selectExpr("id AS row_id", "CAST(id % 7 > 3 AS double) AS label", "CAST(id % 7 AS double) AS a", "repeat('x', 100) AS wide")
    out = V.ensemble_stages(df.where("row_id % 4 > 0"), df.where("row_id % 4 = 0"), ["a"], 5, 3).collect()
    assert [r["stage"] for r in out] == list(M.ENSEMBLE_STAGES) and all(r["test_accuracy"] == 1.0 for r in out)
    assert stored == [] and dealt == [["features", "label"]]


def test_boosted_classifier_stores_what_it_reads(spark, monkeypatch):
    """A checkpoint of all columns and a dealt copy in memory were made of the training rows."""
    stored, plain = [], M.stored_round
    monkeypatch.setattr(M, "cut_lineage", lambda df: stored.append("checkpoint"))
    monkeypatch.setattr(M, "dealt", lambda df, rows: stored.append("dealt"))
    monkeypatch.setattr(M, "stored_round", lambda df: stored.append(df.columns) or plain(df))
    df = spark.range(400).selectExpr("id AS row_id", "CAST(id % 7 > 3 AS double) AS label", "CAST(id % 7 AS double) AS a", "repeat('x', 100) AS wide")
    model = M.fit_classifier("gbdt", df, ["a"], {"n_estimators": 5})
    assert stored == [["features", "label"]] and V.accuracy(model.transform(df)) == 1.0


def test_top_lines_equal_those_of_all_shares(mixed, spark, monkeypatch):
    """Ranked once per row of bins, without a window over all shares; rows of one id are ranked together."""
    _, df = mixed
    df = df.withColumn("row_id", F.when(F.col("row_id") < 20, F.col("row_id") % 7).when(F.col("row_id") > 20, F.col("row_id")))
    df = df.withColumn("row_id", F.when(F.col("row_id") % 50 != 49, F.col("row_id"))).persist()
    model = M.TabularPipeline("boosted", M.CLASSIFICATION, "bought", ["age", "income"], ["job"], options={"n_estimators": 20}).fit(df)
    want = X.top_contributions(X.tree_contributions(model, df, "row_id"), "row_id", 2)
    got = X.top_tree_contributions(model, df, "row_id", 2)
    assert got.dtypes == want.dtypes
    texts = [sorted(f"{r['row_id']} {r['rank']} {r['feature'] if r['row_id'] and r['row_id'] > 20 else ''} {abs(r['contribution']):.9f}" for r in x.collect()) for x in (got, want)]
    assert texts[0] == texts[1]
    seen = []
    monkeypatch.setattr(X, "top_contributions", lambda shares, *rest: seen.append(shares.select("row_id").distinct().count()) or want)
    X.top_tree_contributions(model, df, "row_id", 2)
    assert seen == [df.groupBy("row_id").count().where("count > 1").count()]


def test_shuffled_variants_are_no_rows(mixed, monkeypatch):
    """A forest's importance by the bins of rows and donors equals that of all variants as rows, which were scored one by one."""
    _, df = mixed
    df = df.withColumn("bought", F.when(F.col("row_id") % 37 != 5, F.col("bought"))).withColumn("row_id", F.when(F.col("row_id") % 41 != 3, F.col("row_id"))).persist()
    model = M.TabularPipeline("forest", M.CLASSIFICATION, "bought", ["age", "income"], ["job"], options={"n_estimators": 10, "max_depth": 5}).fit(df)
    scored = []
    plain = type(model.model)._transform
    monkeypatch.setattr(type(model.model), "_transform", lambda self, rows: scored.append(1) or plain(self, rows))
    known = df.where("row_id IS NOT NULL")
    got = X.permutation_importance(model, known, ["age", "income", "job"], "row_id", 3).collect()
    assert not scored
    monkeypatch.setattr(X, "_code_places", lambda *_: None)
    want = X.permutation_importance(model, known, ["age", "income", "job"], "row_id", 3).collect()
    assert scored and [r["feature"] for r in got] == [r["feature"] for r in want]
    np.testing.assert_allclose([r[1:] for r in got], [r[1:] for r in want], atol=1e-12)


def test_images_are_fitted_on_dealt_rows(spark, monkeypatch):
    """A fit's hundreds of steps each had a task per partition of the folds."""
    seen, plain = [], M.logistic

    def spied(*args):
        estimator = plain(*args)
        fit = estimator.fit
        estimator.fit = lambda rows: seen.append((rows.rdd.getNumPartitions(), rows.storageLevel.useMemory)) or fit(rows)
        return estimator

    monkeypatch.setattr(M, "logistic", spied)
    rng = np.random.default_rng(0)
    images = [(i, float(i % 2), (rng.random(64) + i % 2).tolist()) for i in range(60)]
    df = spark.createDataFrame(images, "row_id long, label double, image array<double>")
    assert V.classify_images(df, "raw", splits=3)[1] > 0.9
    assert seen == [(1, True)] * 3
