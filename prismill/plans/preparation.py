"""Preprocessing, split and baseline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismill.functions.keys import MODULUS, scatter_sql
from prismill.operators import metrics, preprocess, splits
from prismill.plans.registry import query, table


def mixed(spark, folder):
    """Customers with their nation, with holes cut by key arithmetic."""
    customer = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return customer.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 != 3, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_custkey") % 5 != 2, F.col("c_custkey") % 13).cast("double").alias("visits"),
        F.when(F.col("c_custkey") % 11 != 4, F.col("c_mktsegment")).alias("segment"),
        F.col("n_name").alias("nation"),
    )


MIXED = """mx AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 3 THEN c_acctbal END AS balance,
    CAST(CASE WHEN c_custkey % 5 <> 2 THEN c_custkey % 13 END AS DOUBLE) AS visits,
    CASE WHEN c_custkey % 11 <> 4 THEN c_mktsegment END AS segment, n_name AS nation
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""

for _how, _fill in (("median", "median({c})"), ("mean", "avg({c})")):

    @query(
        f"impute_numeric_{_how}",
        "B03",
        f"""WITH {MIXED}, f AS (SELECT {_fill.format(c='balance')} AS b, {_fill.format(c='visits')} AS v FROM mx)
        SELECT c_custkey, round(coalesce(balance, b), 4) AS balance, round(coalesce(visits, v), 4) AS visits FROM mx, f""",
    )
    def _imputed(spark, folder, how=_how):
        config = preprocess.PreprocessConfig(numeric_impute=how, scale=False)
        rows = mixed(spark, folder)
        out = preprocess.Preprocessor(["balance", "visits"], [], config).fit(rows).wide(rows)
        return out.select("c_custkey", F.round("balance", 4).alias("balance"), F.round("visits", 4).alias("visits"))


@query(
    "impute_drop_rows",
    "B03 P08",
    f"WITH {MIXED} SELECT c_custkey, balance, visits FROM mx WHERE balance IS NOT NULL AND visits IS NOT NULL",
)
def impute_drop_rows(spark, folder):
    config = preprocess.PreprocessConfig(numeric_impute="drop_rows", scale=False)
    rows = mixed(spark, folder)
    return preprocess.Preprocessor(["balance", "visits"], [], config).fit(rows).wide(rows).select("c_custkey", "balance", "visits")


@query(
    "impute_categorical",
    "B04 A11",
    f"""WITH {MIXED}, m AS (SELECT segment AS s FROM mx WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT c_custkey, coalesce(segment, s) AS segment, coalesce(segment, '（欠測）') AS with_level FROM mx, m""",
)
def impute_categorical(spark, folder):
    rows = mixed(spark, folder).withColumn("with_level", F.col("segment"))
    frequent = preprocess.categorical_fills(rows, ["segment"], "most_frequent")
    constant = preprocess.categorical_fills(rows, ["with_level"], "constant")
    return rows.select(
        "c_custkey", *[F.coalesce(c, F.lit(fill)).alias(c) for c, fill in (frequent | constant).items()]
    )


@query(
    "standardise",
    "B05",
    f"""WITH {MIXED}, f AS (SELECT median(balance) AS b, median(visits) AS v FROM mx),
    i AS (SELECT c_custkey, coalesce(balance, b) AS balance, coalesce(visits, v) AS visits FROM mx, f),
    s AS (SELECT avg(balance) AS bm, stddev_pop(balance) AS bs, avg(visits) AS vm, stddev_pop(visits) AS vs FROM i)
    SELECT c_custkey, round((balance - bm) / bs, 6) AS balance, round((visits - vm) / vs, 6) AS visits FROM i, s""",
)
def standardise(spark, folder):
    rows = mixed(spark, folder)
    out = preprocess.Preprocessor(["balance", "visits"], []).fit(rows).wide(rows)
    return out.select("c_custkey", F.round("balance", 6).alias("balance"), F.round("visits", 6).alias("visits"))


@query(
    "onehot_levels",
    "B06",
    """
    WITH p AS (SELECT p_partkey, p_brand || '/' || p_type AS kind FROM part), c AS (SELECT kind, count(*) AS n FROM p GROUP BY 1),
    r AS (SELECT kind, row_number() OVER (ORDER BY n DESC, kind DESC) AS r, (SELECT count(*) FROM c WHERE n >= 2) AS frequent,
      (SELECT count(*) FROM c WHERE n < 2) AS rare FROM c WHERE n >= 2),
    k AS (SELECT kind FROM r WHERE frequent + CASE WHEN rare > 0 THEN 1 ELSE 0 END <= 30 OR r <= 29)
    SELECT p_partkey, coalesce(k.kind, 'infrequent') AS level FROM p LEFT JOIN k ON p.kind = k.kind
    """,
)
def onehot_levels(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("kind"))
    levels, rare = preprocess.onehot_levels(rows, "kind")
    columns = preprocess.onehot_columns("kind", levels, rare)
    hot = [F.when(c == 1.0, name[len("kind_"):]) for name, c in columns.items()]
    return rows.select("p_partkey", F.coalesce(*hot).alias("level"))


@query(
    "ordinal_codes",
    "B07",
    """
    WITH l AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey % 10 <> 0))
    SELECT p_partkey, coalesce(code, -1) AS code FROM part LEFT JOIN l USING (p_name)
    """,
)
def ordinal_codes(spark, folder):
    part = table(spark, folder, "part")
    levels = preprocess.ordinal_levels(part.where("p_partkey % 10 <> 0"), "p_name")
    return preprocess.ordinal_encode(part, "p_name", levels, "code").select("p_partkey", "code")


@query(
    "inject_missing",
    "B09",
    f"""SELECT o_orderkey, CASE WHEN {scatter_sql('o_orderkey', 3 * 1009)} >= {int(0.2 * MODULUS)} THEN o_totalprice END AS o_totalprice,
    CASE WHEN {scatter_sql('o_orderkey', 3 * 1009 + 1)} >= {int(0.2 * MODULUS)} THEN o_custkey END AS o_custkey FROM orders""",
)
def inject_missing(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return splits.inject_missing(rows, ["o_totalprice", "o_custkey"], 0.2, "o_orderkey", seed=3)


def _rank_sql(source: str, key: str, group: str, seed: int = 0) -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {scatter_sql(key, seed)}, {key}) AS r,
        count(*) OVER (PARTITION BY {group}) AS n FROM {source})"""


@query(
    "hold_out_stratified",
    "B10",
    f"WITH {_rank_sql('orders', 'o_orderkey', 'o_orderstatus')} SELECT o_orderkey, o_orderstatus, CASE WHEN r <= n - ceil(n * 0.3::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM r",
)
def hold_out_stratified(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return splits.hold_out(rows, "o_orderkey", "o_orderstatus")


@query(
    "stratified_folds",
    "B11",
    f"WITH {_rank_sql('orders', 'o_orderkey', 'o_orderpriority', 5)} SELECT o_orderkey, o_orderpriority, CAST((r - 1) % 5 AS INT) AS fold FROM r",
)
def stratified_folds(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return splits.shuffled_folds(rows, "o_orderkey", 5, "o_orderpriority", seed=5)


@query(
    "contiguous_folds",
    "B12",
    """
    WITH r AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels)
    SELECT doc_id, quality, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
      ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INT) AS fold FROM r
    """,
)
def contiguous_folds(spark, folder):
    return splits.contiguous_folds(table(spark, folder, "labels").select("doc_id", "quality"), ["doc_id"], 5)


@query(
    "balanced_folds",
    "B12",
    """
    WITH c AS (SELECT quality, count(*) AS n, min(doc_id) AS f FROM labels GROUP BY 1),
    s AS (SELECT *, sum(n) OVER (ORDER BY f) - n AS st FROM c),
    p AS (SELECT quality, unnest(range(CAST(st AS BIGINT), CAST(st + n AS BIGINT))) % 5 AS m FROM s),
    al AS (SELECT quality, m AS fold, count(*) AS k FROM p GROUP BY 1, 2),
    cu AS (SELECT quality, fold, sum(k) OVER (PARTITION BY quality ORDER BY fold) AS upto FROM al),
    r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS i FROM labels)
    SELECT doc_id, r.quality, CAST(count(*) FILTER (WHERE upto <= i) AS INT) AS fold FROM r JOIN cu ON r.quality = cu.quality GROUP BY 1, 2
    """,
)
def balanced_folds(spark, folder):
    return splits.balanced_folds(table(spark, folder, "labels").select("doc_id", "quality"), ["doc_id"], "quality", 5)


@query(
    "time_ordered_folds",
    "B12",
    """
    WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
    SELECT event_id, CAST(CASE WHEN i >= n - 5 * (n // 6) THEN (i - (n - 5 * (n // 6))) // (n // 6) + 1 ELSE 0 END AS INT) AS fold FROM r
    """,
)
def time_ordered_folds(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "ts")
    return splits.time_ordered_folds(rows, ["ts", "event_id"], 5).select("event_id", "fold")


@query(
    "fold_balance",
    "B12",
    """
    WITH r AS (SELECT doc_id, toxic, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels),
    f AS (SELECT *, CAST(CASE WHEN i < (n % 8) * (n // 8 + 1) THEN i // (n // 8 + 1) ELSE n % 8 + (i - (n % 8) * (n // 8 + 1)) // (n // 8) END AS INT) AS fold FROM r),
    p AS (SELECT fold, count(*) AS rows, count(*) FILTER (WHERE toxic = 1) AS positives FROM f GROUP BY 1)
    SELECT *, (SELECT sum(positives) FROM p) < 8 AS too_few FROM p
    """,
)
def fold_balance(spark, folder):
    rows = table(spark, folder, "labels").select("doc_id", "toxic")
    return splits.fold_balance(splits.contiguous_folds(rows, ["doc_id"], 8), "toxic", 1)


@query(
    "constant_baselines",
    "B13",
    f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY 1 ORDER BY {scatter_sql('o_orderkey')}, o_orderkey) AS k, count(*) OVER () AS n FROM orders),
    h AS (SELECT *, k <= n - ceil(n * 0.3::DOUBLE) AS train FROM r),
    m AS (SELECT arg_max(o_orderpriority, c) AS mode FROM (SELECT o_orderpriority, count(*) AS c FROM h WHERE train GROUP BY 1)),
    v AS (SELECT avg(o_totalprice) AS mean FROM h WHERE train)
    SELECT mode, round(mean, 4) AS mean, round(avg(CASE WHEN o_orderpriority = mode THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
      round(sqrt(avg((o_totalprice - mean) ** 2)), 3) AS rmse FROM h, m, v WHERE NOT train GROUP BY 1, mean
    """,
)
def constant_baselines(spark, folder):
    from prismill.operators.models import baseline_mean, baseline_mode

    rows = splits.hold_out(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey")
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    scored = test.withColumn("mode", baseline_mode(train, "o_orderpriority")).withColumn("mean", baseline_mean(train, "o_totalprice"))
    hit = (F.col("o_orderpriority") == F.col("mode")).cast("double")
    return scored.groupBy("mode", F.round("mean", 4).alias("mean")).agg(
        F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.sqrt(F.avg((F.col("o_totalprice") - F.col("mean")) ** 2)), 3).alias("rmse")
    )


@query(
    "model_comparison",
    "B17 A13",
    """
    WITH p AS (SELECT l_returnflag, l_linenumber % 5 AS fold, l_extendedprice AS a, l_quantity * 2100.0 AS quantity, 3000.0 * l_linenumber AS line,
      avg(l_extendedprice) OVER () AS baseline FROM lineitem),
    l AS (SELECT fold, a, unnest(['quantity', 'line', 'baseline']) AS model, unnest([CAST(quantity AS DOUBLE), CAST(line AS DOUBLE), baseline]) AS p FROM p),
    s AS (SELECT model, fold, 1 - avg((a - p) ** 2) / var_pop(a) AS score FROM l GROUP BY 1, 2),
    m AS (SELECT model, avg(score) AS mean, stddev_pop(score) AS spread, min(score) AS low, max(score) AS high FROM s GROUP BY 1),
    b AS (SELECT mean AS base FROM m WHERE model = 'baseline')
    SELECT model, round(mean, 5) AS mean, round(spread, 5) AS spread, round(low, 5) AS low, round(high, 5) AS high, round(mean - base, 5) AS gain,
      spread > abs(mean - base) AS within_spread FROM m, b
    """,
)
def model_comparison(spark, folder):
    from prismill.operators.validation import compare_scores

    rows = table(spark, folder, "lineitem")
    mean = rows.agg(F.avg("l_extendedprice")).scalar()
    guesses = F.array(
        *[
            F.struct(F.lit(name).alias("model"), value.cast("double").alias("predicted"))
            for name, value in (("quantity", F.col("l_quantity") * 2100.0), ("line", F.col("l_linenumber") * 3000.0), ("baseline", F.col("_mean")))
        ]
    )
    long = rows.withColumn("_mean", mean).select((F.col("l_linenumber") % 5).alias("fold"), F.col("l_extendedprice").alias("actual"), F.inline(guesses))
    scores = metrics.regression_report(long, "actual", "predicted", ["model", "fold"]).select("model", "fold", F.col("r2").alias("score"))
    out = compare_scores(scores, "baseline")
    return out.select("model", *[F.round(c, 5).alias(c) for c in ("mean", "spread", "low", "high", "gain")], "within_spread")
