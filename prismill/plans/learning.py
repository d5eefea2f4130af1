"""Trained-model queries on line items (price level) and embeddings (label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismill.functions.keys import scatter_sql
from prismill.operators import boosting
from prismill.operators import explain as X
from prismill.operators import models as M
from prismill.operators import splits
from prismill.operators import validation as V
from prismill.operators.preprocess import PreprocessConfig
from prismill.plans.registry import query, table
from prismill.session import stored_round

NUMERIC = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
CATEGORICAL = ["l_linestatus", "l_returnflag"]
MEAN = PreprocessConfig(numeric_impute="mean")


def lines(spark, folder):
    """Line items with a row number that comes from their keys."""
    return table(spark, folder, "lineitem").withColumn(
        "row_id", (F.col("l_orderkey") * 7 + F.col("l_linenumber")) * 1009 + F.col("l_partkey") % 1009
    ).withColumn("large", F.when(F.col("l_extendedprice") > 50000, "yes").otherwise("no"))


WIDTH = 64  # coordinates of an embedding


def digits(spark, folder):
    """Embeddings with their coordinates as columns."""
    rows = table(spark, folder, "embeddings")
    return rows.select(
        F.col("vec_id").alias("row_id"), F.col("label").cast("double").alias("label"), F.col("label").cast("string").alias("digit"),
        F.col("embedding").cast("array<double>").alias("image"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(WIDTH)],
    )


XS = [f"x{i}" for i in range(WIDTH)]


def halves(spark, folder):
    placed = splits.hold_out(digits(spark, folder), "row_id", "digit")
    return placed.where("part = 'train'"), placed.where("part = 'test'")


def flagged(spark, folder):
    """Line items as a two-class problem for the classifier registry: the columns its models read, held out once and stored."""
    rows = lines(spark, folder).withColumn("label", (F.col("l_extendedprice") > 50000).cast("double"))
    placed = stored_round(splits.hold_out_in_place(rows.select("row_id", "label", "large", *NUMERIC), "row_id", "large"))
    return placed.where("part = 'train'"), placed.where("part = 'test'")


def placed_lines(spark, folder, target, stratify=None):
    """Line items and their part of the hold-out, stored: a fit passes over them a dozen times, and each would rank all rows again."""
    rows = lines(spark, folder).select("row_id", target, *NUMERIC, *CATEGORICAL)
    return stored_round(splits.hold_out(rows, "row_id", stratify))


@query("hold_out_linear", "B08 B10 B14 E07")
def hold_out_linear(spark, folder):
    placed = placed_lines(spark, folder, "large", "large")
    pipeline = M.TabularPipeline("linear", M.CLASSIFICATION, "large", NUMERIC, CATEGORICAL, MEAN)
    return V.hold_out_scores(pipeline.fit(placed.where("part = 'train'")).transform(placed.where("part = 'test'")), M.CLASSIFICATION)


@query("hold_out_ridge", "B08 B10 B14 E09")
def hold_out_ridge(spark, folder):
    placed = placed_lines(spark, folder, "l_extendedprice")
    pipeline = M.TabularPipeline("linear", M.REGRESSION, "l_extendedprice", NUMERIC, CATEGORICAL, MEAN)
    return V.hold_out_scores(pipeline.fit(placed.where("part = 'train'")).transform(placed.where("part = 'test'")), M.REGRESSION)


@query(
    "ridge_of_one_column",
    "B14 M14",
    """SELECT round(count(*) * covar_pop(l_extendedprice, l_quantity) / stddev_pop(l_quantity) / (count(*) + 50000.0), 4) AS weight,
       round(avg(l_extendedprice), 4) AS start FROM lineitem""",
)
def ridge_of_one_column(spark, folder):
    """One standardised column and a penalty that shows: the weight has a closed form."""
    pipeline = M.TabularPipeline("linear", M.REGRESSION, "l_extendedprice", ["l_quantity"], [], MEAN, options={"alpha": 50000.0})
    model = pipeline.fit(lines(spark, folder)).model
    return spark.createDataFrame([(round(float(model.coefficients[0]), 4), round(float(model.intercept), 4))], "weight double, start double")


_LEVELS = ["l_discount", "l_tax", "l_linenumber"]


@query(
    "tree_of_one_cut",
    "M05",
    f"""
    WITH v AS (SELECT (l_linenumber + 100 * l_discount > 8.5)::INT AS y, unnest([{", ".join(f"'{c}'" for c in _LEVELS)}]) AS feature, unnest([{", ".join(f"{c}::DOUBLE" for c in _LEVELS)}]) AS x FROM lineitem),
    b AS (SELECT feature, x, sum(y) AS y, count(*) AS n FROM v GROUP BY 1, 2),
    r AS (SELECT feature, x, sum(n) OVER w AS n, sum(y) OVER w AS y, sum(n) OVER (PARTITION BY feature) AS tn, sum(y) OVER (PARTITION BY feature) AS ty
      FROM b WINDOW w AS (PARTITION BY feature ORDER BY x)),
    c AS (SELECT *, 2 * (ty / tn) * (1 - ty / tn) - n / tn * 2 * (y / n) * (1 - y / n) - (tn - n) / tn * 2 * ((ty - y) / (tn - n)) * (1 - (ty - y) / (tn - n)) AS gain FROM r WHERE n < tn)
    SELECT feature, CAST(n AS BIGINT) AS rows_left, round(gain, 10) AS gain FROM c ORDER BY c.gain DESC LIMIT 1
    """,
)
def tree_of_one_cut(spark, folder):
    """A tree of depth one against all cuts of columns with few levels."""
    rows = lines(spark, folder).withColumn("label", (F.col("l_linenumber") + 100 * F.col("l_discount") > 8.5).cast("double"))
    root = M.fit_classifier("tree", rows, _LEVELS, {"max_depth": 1}).model._call_java("rootNode")
    feature, cut = _LEVELS[root.split().featureIndex()], root.split().threshold()
    return rows.agg(F.count_if(F.col(feature) <= cut).alias("rows_left")).select(F.lit(feature).alias("feature"), "rows_left", F.round(F.lit(float(root.gain())), 10).alias("gain"))


@query("cross_validated_models", "B08 B11 B13 B14 B15 B16 B17")
def cross_validated_models(spark, folder):
    rows = lines(spark, folder)
    scores = V.cross_validate_models(
        ["linear", "forest", "boosted", "baseline"], rows, "row_id", M.REGRESSION, "l_extendedprice", NUMERIC, CATEGORICAL, MEAN, 5
    )
    return V.compare_scores(scores)


def _forest_model(spark, folder):
    rows = lines(spark, folder)
    pipeline = M.TabularPipeline("forest", M.CLASSIFICATION, "large", NUMERIC, CATEGORICAL, MEAN)
    return rows, pipeline.fit(rows)


@query("permutation_importance", "B18")
def permutation_importance(spark, folder):
    rows, model = _forest_model(spark, folder)
    return X.permutation_importance(model, rows, NUMERIC + CATEGORICAL, "row_id", 5)


@query("unused_features", "B19")
def unused_features(spark, folder):
    """All columns with the verdict, so that the result is not empty when every column helps."""
    rows, model = _forest_model(spark, folder)
    lost = X.permutation_importance(model, rows, NUMERIC + CATEGORICAL, "row_id", 5)
    unused = X.unused_features(lost).select("feature", F.lit(True).alias("unused"))
    return lost.join(unused, "feature", "left").select("feature", F.coalesce("unused", F.lit(False)).alias("unused"))


_RULE = "1500 * l_quantity - 20000 * l_discount"
_DONORS = f"""
    WITH b AS (SELECT (l_orderkey * 7 + l_linenumber) * 1009 + l_partkey % 1009 AS row_id, l_quantity, l_discount, l_extendedprice AS y FROM lineitem),
    o AS (SELECT *, row_number() OVER (ORDER BY {scatter_sql('row_id')}, row_id, l_quantity, l_discount, y) - 1 AS p, count(*) OVER () AS n FROM b),
    v AS (SELECT 'none' AS feature, 0 AS r, y, {_RULE} AS f FROM o
      UNION ALL SELECT 'l_quantity', r, o.y, 1500 * d.l_quantity - 20000 * o.l_discount FROM o, generate_series(1, 3) AS g(r), o AS d WHERE d.p = (o.p + r) % o.n
      UNION ALL SELECT 'l_discount', r, o.y, 1500 * o.l_quantity - 20000 * d.l_discount FROM o, generate_series(1, 3) AS g(r), o AS d WHERE d.p = (o.p + r) % o.n),
    s AS (SELECT feature, r, 1 - avg((y - f) ** 2) / var_pop(y) AS r2 FROM v GROUP BY 1, 2),
    l AS (SELECT feature, (SELECT r2 FROM s WHERE feature = 'none') - r2 AS lost FROM s WHERE feature <> 'none')
"""


def _rule_importance(spark, folder):
    """A formula instead of a fit, so that SQL can follow."""
    rule = M.Formula(F.expr(_RULE), "l_extendedprice")
    return X.permutation_importance(rule, lines(spark, folder), ["l_quantity", "l_discount"], "row_id", 3)


@query(
    "permutation_importance_rule", "B18",
    f"{_DONORS} SELECT feature, round(avg(lost), 7) AS drop_, round(stddev_pop(lost), 7) AS spread FROM l GROUP BY 1",
)
def permutation_importance_rule(spark, folder):
    return _rule_importance(spark, folder).select("feature", F.round("drop", 7).alias("drop_"), F.round("spread", 7).alias("spread"))


@query("unused_features_rule", "B19", f"{_DONORS} SELECT feature, avg(lost) <= 0 AS unused FROM l GROUP BY 1")
def unused_features_rule(spark, folder):
    lost = _rule_importance(spark, folder)
    unused = X.unused_features(lost).select("feature", F.lit(True).alias("unused"))
    return lost.join(unused, "feature", "left").select("feature", F.coalesce("unused", F.lit(False)).alias("unused"))


@query("model_importance", "B20")
def model_importance(spark, folder):
    _, model = _forest_model(spark, folder)
    return X.model_importance(model, spark)


def _boosted_model(spark, folder):
    rows = lines(spark, folder)
    pipeline = M.TabularPipeline("boosted", M.CLASSIFICATION, "large", NUMERIC, CATEGORICAL, MEAN)
    return rows, pipeline.fit(rows)


@query("row_contributions", "B21")
def row_contributions(spark, folder):
    rows, model = _boosted_model(spark, folder)
    return X.mean_contributions(X.tree_contributions(model, rows, "row_id"))


@query("top_contributions", "B22")
def top_contributions(spark, folder):
    rows, model = _boosted_model(spark, folder)
    return X.top_tree_contributions(model, rows, "row_id", 3)


_FIRST = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query(
    "boosted_first_split",
    "B16 T15",
    f"""
    WITH v AS (SELECT l_extendedprice::DOUBLE AS y, unnest([{", ".join(f"'{c}'" for c in _FIRST)}]) AS feature, unnest([{", ".join(f"{c}::DOUBLE" for c in _FIRST)}]) AS x FROM lineitem),
    t AS (SELECT sum(l_extendedprice) / count(*) AS m FROM lineitem),
    b AS (SELECT feature, x, sum(m - y) AS g, count(*) AS n FROM v, t GROUP BY 1, 2),
    r AS (SELECT feature, x, sum(g) OVER w AS g, sum(n) OVER w AS n, sum(g) OVER (PARTITION BY feature) AS all_g, sum(n) OVER (PARTITION BY feature) AS all_n
      FROM b WINDOW w AS (PARTITION BY feature ORDER BY x)),
    c AS (SELECT feature, x, n, g * g / n + (all_g - g) ** 2 / (all_n - n) - all_g ** 2 / all_n AS gain FROM r WHERE n >= 20 AND all_n - n >= 20)
    SELECT feature, x AS at_most, CAST(n AS BIGINT) AS rows_left, round(gain / 1e6, 2) AS gain FROM c ORDER BY c.gain DESC LIMIT 1
    """,
)
def boosted_first_split(spark, folder):
    """Where the first tree cuts first, against all cuts there are."""
    rows = table(spark, folder, "lineitem").select(*_FIRST, F.col("l_extendedprice").alias("y"))
    fitted = boosting.fit(rows, [], _FIRST, "y", settings=boosting.Settings(rounds=1, leaves=2))
    tree = fitted.trees[0][0, 0, 0]
    feature = tree.feature[0]
    cut = float(fitted.cuts[0, 0][feature][tree.bin[0] - 1])
    out = [(_FIRST[feature], cut, tree.rows[tree.left[0]], round(tree.gain[0] / 1e6, 2))]
    return spark.createDataFrame(out, "feature string, at_most double, rows_left long, gain double")


_SETTINGS = {
    "logreg": {}, "svm_linear": {}, "svm_rbf": {"gamma": 0.1}, "tree": {}, "forest": {}, "gbdt": {}, "bagging": {}, "knn": {}, "gnb": {},
}
_ROW = {"logreg": "M01", "knn": "M02", "svm_linear": "M03", "svm_rbf": "M04", "tree": "M05", "forest": "M06", "gbdt": "M07", "bagging": "M08", "gnb": "M09"}

for _key in ("logreg", "svm_linear", "svm_rbf", "tree", "forest", "bagging", "gnb", "knn"):

    @query(f"classifier_{_key}", _ROW[_key])
    def _classifier(spark, folder, key=_key):
        train, test = halves(spark, folder)
        model = M.fit_classifier(key, train, XS, _SETTINGS[key])
        return V.hold_out_scores(model.transform(test), M.CLASSIFICATION)


@query("classifier_gbdt", "M07")
def classifier_gbdt(spark, folder):
    train, test = flagged(spark, folder)
    return V.hold_out_scores(M.fit_classifier("gbdt", train, NUMERIC, _SETTINGS["gbdt"]).transform(test), M.CLASSIFICATION)


@query("parameter_sweep", "M10")
def parameter_sweep(spark, folder):
    train, test = halves(spark, folder)
    return V.parameter_sweep("tree", train, test, XS, "max_depth", [1, 2, 4, 8])


@query("ensemble_stages", "M11")
def ensemble_stages(spark, folder):
    train, test = flagged(spark, folder)
    return V.ensemble_stages(train, test, NUMERIC)


@query("forest_growth", "M12")
def forest_growth(spark, folder):
    train, test = halves(spark, folder)
    growth = V.forest_growth(train, test, XS)
    return growth.withColumn("plateau", V.plateau(growth).select("trees").scalar())


@query("noise_probe", "M13")
def noise_probe(spark, folder):
    train, test = halves(spark, folder)
    return X.noise_probe(train, test, XS, "digit", "row_id", noise=4)


def curve(spark, folder):
    rows = table(spark, folder, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.avg("o_totalprice").alias("price"))
    numbered = rows.select(F.datediff("day", F.lit("1995-01-01")).cast("bigint").alias("row_id"), (F.col("price") / 1000).alias("y"))
    placed = splits.hold_out(numbered.withColumn("x", F.col("row_id") / 2500.0), "row_id")
    return placed.where("part = 'train'"), placed.where("part = 'test'")


@query("polynomial_fits", "M14")
def polynomial_fits(spark, folder):
    train, test = curve(spark, folder)
    rows = [
        (kind, degree, e["train_mse"], e["test_mse"], e["zero_coefficients"])
        for kind, degree, alpha in (("none", 1, 0.0), ("none", 5, 0.0), ("ridge", 5, 1.0), ("lasso", 5, 1.0))
        for e in [V.polynomial_errors(train, test, "x", "y", degree, kind, alpha)]
    ]
    return spark.createDataFrame(rows, "kind string, degree int, train_mse double, test_mse double, zero_coefficients int")


@query(
    "straight_line_fit",
    "M14",
    """
    WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 1000 AS y FROM orders GROUP BY 1),
    p AS (SELECT date_diff('day', DATE '1995-01-01', day) / 2500.0::DOUBLE AS x, y FROM d)
    SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 8) AS r2 FROM p
    """,
)
def straight_line_fit(spark, folder):
    rows = table(spark, folder, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg((F.avg("o_totalprice") / 1000).alias("y"))
    p = rows.select((F.datediff("day", F.lit("1995-01-01")) / 2500.0).alias("x"), "y")
    return p.agg(
        F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.regr_r2("y", "x"), 8).alias("r2")
    )


@query("degree_sweep", "M15")
def degree_sweep(spark, folder):
    train, test = curve(spark, folder)
    sweep = V.degree_sweep(train, test, "x", "y", "row_id")
    return sweep.withColumn("best_degree", V.best_degree(sweep).select("degree").scalar())


@query("image_classes_by_features", "I07")
def image_classes_by_features(spark, folder):
    """Cross-validated accuracy per feature set."""
    rows = digits(spark, folder).select("row_id", "label", "digit", "image")
    out = [(name, *V.classify_images(rows, name)) for name in ("raw", "hog", "edges")]
    return spark.createDataFrame(out, "features string, n_features int, accuracy double")
