"""Catalog, profile and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismill.functions.keys import scatter_sql
from prismill.operators import ordering, profile
from prismill.plans.registry import query, table
from prismill.sources.catalog import run_read_only
from prismill.sources.names import slug, valid_name


def masked_events(spark, folder):
    """Events with holes cut by key arithmetic, for jobs about missing values."""
    return table(spark, folder, "events").select(
        "event_id", "event_type",
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 9 != 0, F.col("user_id")).alias("user_id"),
    )


MASKED_EVENTS = """
    SELECT event_id, event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value,
           CASE WHEN event_id % 9 <> 0 THEN user_id END AS user_id FROM events
"""


def _profile_sql(columns):
    parts = [
        f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) - count({c}) AS nulls, "
        f"round((count(*) - count({c})) / count(*), 6) AS null_rate, count(DISTINCT {c}) AS \"distinct\", '{role}' AS role FROM e"
        for c, kind, role in columns
    ]
    return f"WITH e AS ({MASKED_EVENTS}) " + " UNION ALL ".join(parts)


@query(
    "column_profile",
    "C10",
    _profile_sql(
        [("event_id", "bigint", "numeric"), ("event_type", "string", "target"),
         ("value", "double", "numeric"), ("user_id", "bigint", "numeric")]
    ),
)
def column_profile(spark, folder):
    out = profile.profile_columns(masked_events(spark, folder), target="event_type")
    return out.withColumn("null_rate", F.round("null_rate", 6))


@query(
    "null_rate_ranking",
    "A06",
    f"""
    WITH e AS ({MASKED_EVENTS}), r AS (
      SELECT 'value' AS "column", avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS rate FROM e UNION ALL
      SELECT 'user_id', avg(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) FROM e)
    SELECT "column", round(rate, 6) AS rate FROM r WHERE rate > 0
    """,
)
def null_rate_ranking(spark, folder):
    return profile.null_rates(masked_events(spark, folder)).withColumn("rate", F.round("rate", 6))


@query(
    "summarize_exact_part",
    "C11",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max,
        {'round(avg(' + c + '), 4)' if number else 'CAST(NULL AS DOUBLE)'} AS avg,
        {'round(stddev_samp(' + c + '), 4)' if number else 'CAST(NULL AS DOUBLE)'} AS std,
        count(*) AS count, round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_percentage FROM supplier"""
        for c, number in [("s_suppkey", True), ("s_name", False), ("s_nationkey", True), ("s_acctbal", True)]
    ),
)
def summarize_exact_part(spark, folder):
    table(spark, folder, "supplier").createOrReplaceTempView("supplier")
    out = run_read_only(spark, "SUMMARIZE supplier")
    return out.select(
        "column_name", "min", "max", F.round("avg", 4).alias("avg"), F.round("std", 4).alias("std"),
        "count", F.round("null_percentage", 4).alias("null_percentage"),
    )


@query("summarize_lineitem", "C11")
def summarize_lineitem(spark, folder):
    table(spark, folder, "lineitem").createOrReplaceTempView("lineitem")
    return run_read_only(spark, "SUMMARIZE SELECT * FROM lineitem")


@query(
    "describe_numeric",
    "C12",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
        round(quantile_cont({c}, 0.75), 4) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def describe_numeric(spark, folder):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = profile.describe_numeric(table(spark, folder, "lineitem"), names)
    rounded = [F.round(c, 4).alias(c) for c in ("mean", "std", "q25", "q50", "q75")]
    return out.select("column", "count", "min", "max", *rounded)


@query(
    "histogram_40",
    "C13",
    """
    WITH b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 40 AS w FROM orders)
    SELECT CAST(least(39, floor((o_totalprice - lo) / w)) AS INT) AS bin, count(*) AS n FROM orders, b GROUP BY 1
    """,
)
def histogram_40(spark, folder):
    return profile.histogram(table(spark, folder, "orders"), "o_totalprice", 40).select("bin", "n")


@query(
    "thinned_rows",
    "C14",
    """
    WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i,
               count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, o_totalprice FROM r WHERE (i - 1) % greatest(1, n // 5000) = 0
    """,
)
def thinned_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return ordering.every_kth(orders, ["o_orderdate", "o_orderkey"], 5000).select("o_orderkey", "o_totalprice")


@query(
    "random_sample",
    "C15",
    f"SELECT o_orderkey FROM orders ORDER BY {scatter_sql('o_orderkey', 7)}, o_orderkey LIMIT 8000",
)
def random_sample(spark, folder):
    return profile.sample_rows(table(spark, folder, "orders"), 8000, "o_orderkey", seed=7).select("o_orderkey")


@query(
    "label_candidates",
    "P12",
    """
    WITH c AS (SELECT 'lang' AS "column", count(DISTINCT lang) AS levels FROM documents
      UNION ALL SELECT 'source', count(DISTINCT source) FROM documents
      UNION ALL SELECT 'text', count(DISTINCT text) FROM documents)
    SELECT * FROM c WHERE levels BETWEEN 2 AND 30
    """,
)
def label_candidates(spark, folder):
    return profile.label_candidates(table(spark, folder, "documents"))


@query(
    "typed_columns",
    "P10 P11",
)
def typed_columns(spark, folder):
    """Role of every column, from the schema; the row count shows the table was read."""
    orders = table(spark, folder, "orders")
    numeric, categorical = profile.split_columns(orders, "o_totalprice")
    rows = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.lit(name).alias("column"))
            for role, names in (
                ("time", profile.time_columns(orders)), ("value", profile.value_columns(orders, "o_orderdate")),
                ("numeric", numeric), ("categorical", categorical),
            )
            for name in names
        ]
    )
    return orders.agg(F.count("*").alias("rows")).select("rows", F.inline(rows))


@query(
    "dataset_slugs",
    "C06",
    r"""
    SELECT p_partkey, 'market_' || trim(regexp_replace(lower(p_brand), '[^\p{L}\p{N}]', '_', 'g'), '_') AS slug,
      regexp_matches('market_' || trim(regexp_replace(lower(p_brand), '[^\p{L}\p{N}]', '_', 'g'), '_'), '^[a-z][a-z0-9_]{0,62}$') AS valid
    FROM part
    """,
)
def dataset_slugs(spark, folder):
    name = slug(F.col("p_brand"), "market", "asset")
    return table(spark, folder, "part").select("p_partkey", name.alias("slug"), valid_name(name).alias("valid"))


@query(
    "numeric_label_names",
    "C23",
    """
    SELECT v.vec_id, CASE v.label WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' WHEN 4 THEN 'four'
      WHEN 5 THEN 'five' WHEN 6 THEN 'six' WHEN 7 THEN 'seven' WHEN 8 THEN 'eight' WHEN 9 THEN 'nine' END AS digit FROM embeddings v
    """,
)
def numeric_label_names(spark, folder):
    from prismill.sources.payloads import label_targets

    names = "zero one two three four five six seven eight nine".split()
    return label_targets(table(spark, folder, "embeddings").select("vec_id", "label"), "label", names, "digit").drop("label")


@query(
    "inferred_task",
    "B01",
    """
    SELECT 'l_linenumber' AS "column", 'classification' AS task, count(*) AS n, count(DISTINCT l_linenumber) AS levels FROM lineitem
    UNION ALL SELECT 'l_returnflag', 'classification', count(*), count(DISTINCT l_returnflag) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'regression', count(*), count(DISTINCT l_extendedprice) FROM lineitem
    UNION ALL SELECT 'l_quantity', CASE WHEN count(DISTINCT l_quantity) <= 2 OR (bool_and(l_quantity % 1 = 0) AND count(DISTINCT l_quantity) <= 20)
      THEN 'classification' ELSE 'regression' END, count(*), count(DISTINCT l_quantity) FROM lineitem
    """,
)
def inferred_task(spark, folder):
    from functools import reduce

    rows = table(spark, folder, "lineitem")
    parts = [profile.infer_task(rows, c) for c in ("l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "suggested_targets",
    "B02",
    """
    WITH c AS (SELECT count(*) AS n, count(DISTINCT c_custkey) AS a, count(DISTINCT c_name) AS b, count(DISTINCT c_nationkey) AS c,
      count(DISTINCT c_acctbal) AS d, count(DISTINCT c_mktsegment) AS e FROM customer),
    r AS (SELECT 'c_custkey' AS "column", 0 AS position, a > greatest(50, 0.9 * n) AS late FROM c
      UNION ALL SELECT 'c_name', 1, b > greatest(50, 0.9 * n) FROM c UNION ALL SELECT 'c_nationkey', 2, c > greatest(50, 0.9 * n) FROM c
      UNION ALL SELECT 'c_acctbal', 3, d > greatest(50, 0.9 * n) FROM c UNION ALL SELECT 'c_mktsegment', 4, e > greatest(50, 0.9 * n) FROM c)
    SELECT CAST(late AS INT) AS unlikely, position, "column" FROM r
    """,
)
def suggested_targets(spark, folder):
    return profile.suggest_targets(table(spark, folder, "customer"))


def scratch_folder(spark, name):
    """A new folder next to the checkpoints, where all executors can write."""
    import uuid

    from prismill.session import checkpoint_folder

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "catalog_round_trip",
    "C01 C02 C03 C04 C05 C07 C08 C09",
    """
    SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, (SELECT count(*) FROM customer) AS stored_rows, 2 AS datasets
    FROM customer GROUP BY c_mktsegment
    """,
)
def catalog_round_trip(spark, folder):
    """Save three datasets, delete one, then query another through the catalog."""
    from prismill.sources.catalog import Catalog

    catalog = Catalog(spark, scratch_folder(spark, "catalog"))
    for name in ("customer", "nation", "region"):
        catalog.save(f"stored_{name}", table(spark, folder, name), label=name, source="tables", domain="table", params={"folder": folder})
    catalog.delete("stored_region")
    facts = catalog.describe("stored_customer")
    rows = catalog.query(
        "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM stored_customer GROUP BY c_mktsegment"
    )
    listed = catalog.list_datasets().agg(F.count("*").cast("int")).scalar()
    return rows.withColumn("stored_rows", F.lit(facts["rows"]).cast("bigint")).withColumn("datasets", listed)


@query("csv_export", "C16", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_export(spark, folder):
    """Write CSV and read it back."""
    from prismill.sources.catalog import export_csv

    nation, target = table(spark, folder, "nation"), scratch_folder(spark, "csv")
    export_csv(nation, target)
    return spark.read.schema(nation.schema).option("header", True).csv(target)
