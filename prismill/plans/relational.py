"""Projection, join, aggregate, window and ordering queries over the given tables.

SQL texts go through the guarded read-only path; the rest uses the DataFrame API.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismill.functions.rounding import settled, settled_sql
from prismill.operators import ordering, profile, series
from prismill.plans.registry import query, register_tables, table
from prismill.session import cut_lineage
from prismill.sources.catalog import run_read_only

# Daily series used as the stand-in for weather (orders) and prices (line items).
DAILY_ORDERS = """
    SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS mean_price, sum(o_totalprice) AS total,
           max(o_totalprice) AS top_price, count(*) AS n
    FROM orders GROUP BY CAST(o_orderdate AS DATE)
"""
DAILY_SHIPS = """
    SELECT CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice) AS close, sum(l_quantity) AS volume
    FROM lineitem GROUP BY CAST(l_shipdate AS DATE)
"""


def sql(spark, folder, names, text):
    register_tables(spark, folder, names)
    return run_read_only(spark, text)


@query("select_limit", "P01 C02 C07 C08", "SELECT * FROM part ORDER BY p_partkey LIMIT 20")
def select_limit(spark, folder):
    return sql(spark, folder, ["part"], "SELECT * FROM part ORDER BY p_partkey LIMIT 20")


@query("row_count", "P02 C08", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, folder):
    return sql(spark, folder, ["lineitem"], "SELECT count(*) AS n FROM lineitem;")


_KEYWORD = """
    SELECT doc_id, source, lang FROM documents WHERE text LIKE '%tion%' ORDER BY doc_id DESC
"""


@query("keyword_filter", "P03", _KEYWORD)
def keyword_filter(spark, folder):
    return sql(spark, folder, ["documents"], _KEYWORD)


@query(
    "null_filter_top_k",
    "P04 O01 W09",
    f"""
    WITH d AS ({DAILY_SHIPS}),
    r AS (SELECT day, close, 100 * (close / lag(close) OVER (ORDER BY day) - 1) AS change FROM d)
    SELECT strftime(day, '%Y-%m-%d') AS day, round(close + 0.000000123, 4) AS close, round(change + 0.000000123, 4) AS change
    FROM r WHERE change IS NOT NULL ORDER BY abs(change) DESC, day LIMIT 20
    """,
)
def null_filter_top_k(spark, folder):
    text = f"""
    WITH d AS ({DAILY_SHIPS}),
    r AS (SELECT day, close, 100 * (close / lag(close) OVER (ORDER BY day) - 1) AS change FROM d)
    SELECT date_format(day, 'yyyy-MM-dd') AS day, round(close + 0.000000123, 4) AS close, round(change + 0.000000123, 4) AS change
    FROM r WHERE change IS NOT NULL ORDER BY abs(r.change) DESC, day LIMIT 20
    """
    return sql(spark, folder, ["lineitem"], text)


_CTE = """
    WITH big AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey)
    SELECT c_mktsegment, count(*) AS customers, round(avg(spent), 2) AS mean_spent
    FROM big JOIN customer ON o_custkey = c_custkey WHERE spent > 1000 GROUP BY c_mktsegment
"""


@query("common_table_expression", "P05", _CTE)
def common_table_expression(spark, folder):
    return sql(spark, folder, ["orders", "customer"], _CTE)


@query(
    "quoted_identifiers",
    "P06 A01",
    """
    WITH t AS (SELECT c_acctbal AS "残高", c_mktsegment AS "区分" FROM customer)
    SELECT "区分", round(avg("残高"), 2) AS "残高_平均", min("残高") AS "残高_最小", max("残高") AS "残高_最大"
    FROM t GROUP BY "区分"
    """,
)
def quoted_identifiers(spark, folder):
    text = """
    WITH t AS (SELECT c_acctbal AS `残高`, c_mktsegment AS `区分` FROM customer)
    SELECT `区分`, round(avg(`残高`), 2) AS `残高_平均`, min(`残高`) AS `残高_最小`, max(`残高`) AS `残高_最大`
    FROM t GROUP BY `区分`
    """
    return sql(spark, folder, ["customer"], text)


@query("from_first", "P07", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def from_first(spark, folder):
    return sql(
        spark, folder, ["customer"],
        "FROM customer SELECT c_mktsegment, count(*) AS n GROUP BY c_mktsegment",
    )


@query("table_statement", "P07 P01", "SELECT * FROM nation")
def table_statement(spark, folder):
    return sql(spark, folder, ["nation"], "TABLE nation")


@query(
    "describe_table", "P07",
    "SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS col_name, unnest([count(event_id), count(ts), count(user_id), count(event_type), count(value), count(props)]) AS filled FROM events",
)
def describe_table(spark, folder):
    """The columns a table says it has, and how many rows fill each."""
    told = sql(spark, folder, ["events"], "DESCRIBE events").select("col_name")
    names = [r["col_name"] for r in told.collect()]  # a row per column
    counts = table(spark, folder, "events").agg(*[F.count(F.col(f"`{n}`")).alias(n) for n in names])
    return told.join(counts.unpivot([], names, "name", "filled"), F.col("col_name") == F.col("name")).select("col_name", "filled")


@query("shown_tables", "P07 P02", "SELECT 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def shown_tables(spark, folder):
    """The tables that SHOW lists, and how many rows each has."""
    listed = sql(spark, folder, ["part", "supplier"], "SHOW TABLES").where("tableName IN ('part', 'supplier')")
    names = sorted(r["tableName"] for r in listed.collect())
    parts = [sql(spark, folder, [n], f"SELECT '{n}' AS name, count(*) AS n FROM {n}") for n in names]
    return reduce(lambda a, b: a.unionByName(b), parts)


_MEASURES = """
    SELECT round(avg(l_quantity), 2) AS quantity_mean, min(l_quantity) AS quantity_min, max(l_quantity) AS quantity_max,
           round(avg(l_extendedprice), 2) AS price_mean, min(l_extendedprice) AS price_min, max(l_extendedprice) AS price_max,
           round(avg(l_discount), 4) AS discount_mean, min(l_discount) AS discount_min, max(l_discount) AS discount_max
    FROM lineitem
"""


@query("rounded_measures", "A01", _MEASURES)
def rounded_measures(spark, folder):
    return sql(spark, folder, ["lineitem"], _MEASURES)


@query(
    "month_rollup",
    "A02",
    """
    SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 2) AS mean_price,
           round(sum(o_totalprice), 1) AS total_price
    FROM orders GROUP BY 1 ORDER BY 1
    """,
)
def month_rollup(spark, folder):
    text = """
    SELECT date_format(o_orderdate, 'yyyy-MM') AS month, round(avg(o_totalprice), 2) AS mean_price,
           round(sum(o_totalprice), 1) AS total_price
    FROM orders GROUP BY 1 ORDER BY 1
    """
    return sql(spark, folder, ["orders"], text)


_CONDITIONAL = """
    SELECT CAST(year(o_orderdate) AS BIGINT) AS year,
           count(*) FILTER (WHERE o_totalprice >= 400000) AS very_large,
           count(*) FILTER (WHERE o_totalprice >= 300000) AS large
    FROM orders GROUP BY 1 ORDER BY 1
"""


@query("conditional_counts", "A03", _CONDITIONAL)
def conditional_counts(spark, folder):
    return sql(spark, folder, ["orders"], _CONDITIONAL)


_GROUP = "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source"


@query("group_count", "A04", _GROUP)
def group_count(spark, folder):
    return sql(spark, folder, ["documents"], _GROUP)


@query(
    "class_balance",
    "A05",
    """
    WITH c AS (SELECT quality AS class, count(*) AS n FROM labels GROUP BY quality)
    SELECT class, n, round(n / sum(n) OVER (), 6) AS share, round(min(n) OVER () / max(n) OVER (), 6) AS balance FROM c
    """,
)
def class_balance(spark, folder):
    counts = table(spark, folder, "labels").groupBy(F.col("quality").alias("class")).agg(F.count("*").alias("n"))
    total, low, high = (counts.agg(f("n")).scalar() for f in (F.sum, F.min, F.max))
    return counts.select(
        "class", "n", F.round(F.col("n") / total, 6).alias("share"), F.round(low / high, 6).alias("balance")
    )


_AVERAGE = """
    WITH d AS ({daily})
    SELECT {fmt} AS day, round(mean_price + 0.0000123, 2) AS mean_price,
           round(avg(mean_price) OVER (ORDER BY day ROWS 19 PRECEDING) + 0.0000123, 2) AS moving_average
    FROM d ORDER BY 1 DESC
"""


@query(
    "moving_average_partial",
    "W01 A02",
    _AVERAGE.format(daily=DAILY_ORDERS, fmt="strftime(day, '%Y-%m-%d')"),
)
def moving_average_partial(spark, folder):
    text = _AVERAGE.format(daily=DAILY_ORDERS, fmt="date_format(day, 'yyyy-MM-dd')")
    return sql(spark, folder, ["orders"], text)


def daily_orders(spark, folder):
    """Daily orders per priority: (series, ts, value), one row per day that has orders."""
    orders = table(spark, folder, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("ts")
    ).agg(F.avg("o_totalprice").alias("value"))


DAILY_BY_PRIORITY = """
    SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) AS value
    FROM orders GROUP BY 1, 2
"""


@query(
    "moving_average_full",
    "W02",
    f"""
    WITH d AS ({DAILY_BY_PRIORITY})
    SELECT series, strftime(ts, '%Y-%m-%d') AS ts,
      CASE WHEN count(value) OVER w7 = 7 THEN {settled_sql('avg(value) OVER w7', 4)} END AS ma_7,
      CASE WHEN count(value) OVER w28 = 28 THEN {settled_sql('avg(value) OVER w28', 4)} END AS ma_28
    FROM d WINDOW w7 AS (PARTITION BY series ORDER BY ts ROWS 6 PRECEDING),
                  w28 AS (PARTITION BY series ORDER BY ts ROWS 27 PRECEDING)
    """,
)
def moving_average_full(spark, folder):
    out = series.moving_averages(daily_orders(spark, folder), ["series"], windows=(7, 28))
    return out.select(
        "series", F.date_format("ts", "yyyy-MM-dd").alias("ts"),
        settled("ma_7", 4), settled("ma_28", 4),
    )


@query(
    "lag_lead_difference",
    "W03 W04 W08 W09",
    f"""
    WITH d AS ({DAILY_BY_PRIORITY})
    SELECT series, strftime(ts, '%Y-%m-%d') AS ts, {settled_sql('lag(value, 3) OVER w', 4)} AS lag_3,
      {settled_sql('lead(value, 2) OVER w', 4)} AS lead_2, {settled_sql('value - lag(value) OVER w', 4)} AS difference,
      round(100 * (value / lag(value) OVER w - 1), 6) AS percent_change
    FROM d WINDOW w AS (PARTITION BY series ORDER BY ts)
    """,
)
def lag_lead_difference(spark, folder):
    w = Window.partitionBy("series").orderBy("ts")
    before = F.lag("value").over(w)
    return daily_orders(spark, folder).select(
        "series", F.date_format("ts", "yyyy-MM-dd").alias("ts"),
        settled(F.lag("value", 3).over(w), 4).alias("lag_3"),
        settled(F.lead("value", 2).over(w), 4).alias("lead_2"),
        settled(F.col("value") - before, 4).alias("difference"),
        F.round(100 * (F.col("value") / before - 1), 6).alias("percent_change"),
    )


@query(
    "past_only_rolling",
    "W05 W06",
    f"""
    WITH d AS ({DAILY_BY_PRIORITY})
    SELECT series, strftime(ts, '%Y-%m-%d') AS ts,
      CASE WHEN count(value) OVER p = 7 THEN {settled_sql('avg(value) OVER p', 4)} END AS mean_7,
      CASE WHEN count(value) OVER p = 7 THEN {settled_sql('stddev_samp(value) OVER p', 3)} END AS std_7,
      {settled_sql('avg(value) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)', 3)} AS expanding_mean
    FROM d WINDOW p AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
    """,
)
def past_only_rolling(spark, folder):
    w = Window.partitionBy("series").orderBy("ts")
    past = w.rowsBetween(-7, -1)
    full = F.count("value").over(past) == 7
    return daily_orders(spark, folder).select(
        "series", F.date_format("ts", "yyyy-MM-dd").alias("ts"),
        F.when(full, settled(F.avg("value").over(past), 4)).alias("mean_7"),
        F.when(full, settled(F.stddev_samp("value").over(past), 3)).alias("std_7"),
        settled(F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 3).alias("expanding_mean"),
    )


@query(
    "forward_fill",
    "W07",
    f"""
    WITH d AS ({DAILY_BY_PRIORITY}),
    m AS (SELECT series, ts, CASE WHEN extract('day' FROM ts) % 4 <> 1 THEN value END AS value FROM d),
    f AS (SELECT series, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts
          ROWS UNBOUNDED PRECEDING) AS value FROM m)
    SELECT series, strftime(ts, '%Y-%m-%d') AS ts, {settled_sql('value', 4)} AS value FROM f WHERE value IS NOT NULL
    """,
)
def forward_fill(spark, folder):
    holes = daily_orders(spark, folder).withColumn("value", F.when(F.day("ts") % 4 != 1, F.col("value")))
    return series.fill_forward(holes, ["series"]).select(
        "series", F.date_format("ts", "yyyy-MM-dd").alias("ts"), settled("value", 4)
    )


_JOIN = """
    WITH w AS ({orders}), m AS ({ships})
    SELECT {fmt} AS day, round(w.mean_price + 0.000000123, 4) AS mean_price, round(m.close + 0.000000123, 4) AS close
    FROM w JOIN m ON w.day = m.day ORDER BY 1 DESC LIMIT 50
"""


@query("join_series_on_date", "J01", _JOIN.format(orders=DAILY_ORDERS, ships=DAILY_SHIPS, fmt="strftime(w.day, '%Y-%m-%d')"))
def join_series_on_date(spark, folder):
    text = _JOIN.format(orders=DAILY_ORDERS, ships=DAILY_SHIPS, fmt="date_format(w.day, 'yyyy-MM-dd')")
    return sql(spark, folder, ["orders", "lineitem"], text)


_ENRICH = """
    SELECT n_name, c_mktsegment, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name, c_mktsegment, o_orderpriority
"""


@query("join_orders_customers", "J01", _ENRICH)
def join_orders_customers(spark, folder):
    return sql(spark, folder, ["orders", "customer", "nation"], _ENRICH)


@query(
    "lookup_with_fallback",
    "J02",
    """
    SELECT coalesce(r_name, CAST(c_nationkey % 7 AS VARCHAR)) AS area, count(*) AS n, round(sum(c_acctbal), 2) AS balance
    FROM customer LEFT JOIN region ON r_regionkey = c_nationkey % 7 GROUP BY 1
    """,
)
def lookup_with_fallback(spark, folder):
    code = F.col("c_nationkey") % 7
    region = table(spark, folder, "region")
    joined = table(spark, folder, "customer").withColumn("code", code).join(
        region, F.col("code") == F.col("r_regionkey"), "left"
    )
    area = F.coalesce("r_name", F.col("code").cast("string"))
    return joined.groupBy(area.alias("area")).agg(
        F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


@query(
    "align_to_points",
    "J03 J04",
    f"""
    WITH d AS ({DAILY_BY_PRIORITY}),
    p AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS ts FROM lineitem WHERE extract('day' FROM l_shipdate) = 1)
    SELECT strftime(p.ts, '%Y-%m-%d') AS ts, d.series, {settled_sql('d.value', 4)} AS value FROM p LEFT JOIN d ON d.ts = p.ts
    """,
)
def align_to_points(spark, folder):
    points = (
        table(spark, folder, "lineitem").where(F.day("l_shipdate") == 1)
        .select(F.col("l_shipdate").cast("date").alias("ts")).distinct()
    )
    return points.join(daily_orders(spark, folder), "ts", "left").select(
        F.date_format("ts", "yyyy-MM-dd").alias("ts"), "series", settled("value", 4)
    )


@query(
    "group_mean_spread",
    "A08",
    """
    WITH g AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2)
    SELECT o_orderstatus AS status, count(*) AS tried, round(max(m) - min(m), 2) AS spread,
           arg_max(o_orderpriority, m) AS best FROM g GROUP BY 1
    """,
)
def group_mean_spread(spark, folder):
    means = table(spark, folder, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(
        F.avg("o_totalprice").alias("m")
    )
    return means.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("tried"), F.round(F.max("m") - F.min("m"), 2).alias("spread"),
        F.max_by("o_orderpriority", "m").alias("best"),
    )


@query(
    "row_with_maximum",
    "A09",
    """
    SELECT o_orderpriority, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r
      FROM orders WHERE o_totalprice IS NOT NULL) WHERE r = 1
    """,
)
def row_with_maximum(spark, folder):
    orders = table(spark, folder, "orders").where("o_totalprice IS NOT NULL")
    best = F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), "o_orderkey"))
    return orders.groupBy("o_orderpriority").agg(
        best.alias("o_orderkey"), F.max("o_totalprice").alias("o_totalprice")
    )


@query(
    "pivot_counts",
    "A10",
    """
    SELECT l_returnflag, round(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 1) AS "F",
           round(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 1) AS "O"
    FROM lineitem GROUP BY l_returnflag
    """,
)
def pivot_counts(spark, folder):
    return (
        table(spark, folder, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"])
        .agg(F.round(F.sum("l_extendedprice"), 1))
    )


@query(
    "most_frequent_value",
    "A11",
    """
    SELECT p_type, p_size AS size, n FROM (
      SELECT p_type, p_size, count(*) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_size) AS r
      FROM part GROUP BY p_type, p_size) WHERE r = 1
    """,
)
def most_frequent_value(spark, folder):
    return ordering.most_frequent(table(spark, folder, "part"), "p_size", ["p_type"]).withColumnRenamed("p_size", "size")


@query(
    "median_and_mad",
    "A12",
    """
    WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS med FROM lineitem GROUP BY 1)
    SELECT l.l_returnflag, round(any_value(med), 4) AS median, round(median(abs(l_extendedprice - med)), 4) AS mad
    FROM lineitem l JOIN m USING (l_returnflag) GROUP BY 1
    """,
)
def median_and_mad(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice")
    # stored, because the second pass reads it several times
    medians = cut_lineage(ordering.exact_quantiles(rows, "l_extendedprice", {"median": 0.5}, ["l_returnflag"]))
    # one row per flag; joined by a shuffle, a few flags would bring all rows to as many tasks
    away = rows.join(F.broadcast(medians), "l_returnflag").select(
        "l_returnflag", F.abs(F.col("l_extendedprice") - F.col("median")).alias("away")
    )
    mads = ordering.exact_quantiles(away, "away", {"mad": 0.5}, ["l_returnflag"])
    return medians.join(mads, "l_returnflag").select(
        "l_returnflag", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad")
    )


@query(
    "distinct_sorted",
    "A07",
    "SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL ORDER BY event_type",
)
def distinct_sorted(spark, folder):
    return profile.distinct_values(table(spark, folder, "events"), "event_type")


@query(
    "rows_complete",
    "P08",
    """
    WITH e AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value,
               CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS k FROM events)
    SELECT * FROM e WHERE value IS NOT NULL AND k IS NOT NULL
    """,
)
def rows_complete(spark, folder):
    masked = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 7 != 0, F.get_json_object("props", "$.k").cast("double")).alias("k"),
    )
    return profile.drop_rows_with_nulls(masked, ["value", "k"])


@query(
    "columns_not_empty",
    "P09",
    "SELECT r_regionkey, r_name FROM region",
)
def columns_not_empty(spark, folder):
    region = table(spark, folder, "region").withColumn("empty", F.lit(None).cast("double"))
    return profile.drop_empty_columns(region)


@query(
    "text_columns_joined",
    "P13",
    """
    SELECT p_partkey, trim(coalesce(p_name, '') || ' ' || coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_brand END, '')
      || ' ' || coalesce(p_type, '')) AS document
    FROM part
    """,
)
def text_columns_joined(spark, folder):
    part = table(spark, folder, "part").withColumn("p_brand", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")))
    return profile.join_text(part, ["p_name", "p_brand", "p_type"]).select("p_partkey", "document")


@query(
    "sort_nulls_last",
    "O02",
    """
    SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN value END AS value FROM events
    ORDER BY value DESC NULLS LAST, event_id LIMIT 100
    """,
)
def sort_nulls_last(spark, folder):
    masked = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("value")
    )
    return masked.orderBy(F.desc_nulls_last("value"), "event_id").limit(100)


@query(
    "top_k_per_group",
    "O03 W11",
    """
    SELECT event_type, event_id, value, r AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5
    """,
)
def top_k_per_group(spark, folder):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return (
        table(spark, folder, "events").withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 5")
        .select("event_type", "event_id", "value", "rank")
    )


@query(
    "sort_by_magnitude",
    "O04",
    """
    SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS residual FROM customer
    ORDER BY abs(c_acctbal - (SELECT avg(c_acctbal) FROM customer)) DESC, c_custkey LIMIT 25
    """,
)
def sort_by_magnitude(spark, folder):
    customer = table(spark, folder, "customer")
    residual = F.col("c_acctbal") - customer.agg(F.avg("c_acctbal")).scalar()
    out = customer.withColumn("residual", residual).orderBy(F.desc(F.abs("residual")), "c_custkey").limit(25)
    return out.select("c_custkey", F.round("residual", 4).alias("residual"))


@query(
    "union_by_name",
    "U01",
    """
    SELECT s_nationkey AS nation, s_acctbal AS balance, NULL AS segment FROM supplier
    UNION ALL SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer
    """,
)
def union_by_name(spark, folder):
    old = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    new = table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")
    )
    return old.unionByName(new, allowMissingColumns=True)


@query(
    "union_keep_first",
    "U02 C20",
    """
    SELECT text, doc_id, batch FROM (
      SELECT *, row_number() OVER (PARTITION BY text ORDER BY batch, doc_id) AS r FROM (
        SELECT text, doc_id, 0 AS batch FROM documents WHERE lang <> 'en'
        UNION ALL SELECT text, doc_id, 1 AS batch FROM documents)) WHERE r = 1
    """,
)
def union_keep_first(spark, folder):
    docs = table(spark, folder, "documents").select("text", "doc_id")
    old = table(spark, folder, "documents").where("lang <> 'en'").select("text", "doc_id")
    both = old.withColumn("batch", F.lit(0)).unionByName(docs.withColumn("batch", F.lit(1)))
    return ordering.first_per_key(both, ["text"], ["batch", "doc_id"])


@query(
    "anti_filter",
    "U03 L09",
    "SELECT event_id, event_type FROM events WHERE event_type <> 'error' OR event_type IS NULL",
)
def anti_filter(spark, folder):
    return table(spark, folder, "events").where(~F.col("event_type").eqNullSafe("error")).select("event_id", "event_type")


@query(
    "running_best",
    "W10 L08",
    """
    WITH e AS (SELECT user_id % 3 AS experiment, event_id, ts,
               CASE WHEN event_id % 11 <> 0 THEN value END AS value FROM events)
    SELECT experiment, event_id, value, CASE WHEN value IS NOT NULL THEN
       max(value) OVER (PARTITION BY experiment ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS best FROM e
    """,
)
def running_best(spark, folder):
    rows = table(spark, folder, "events").select(
        (F.col("user_id") % 3).alias("experiment"), "event_id", "ts",
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"),
    )
    best = ordering.running(rows, ["experiment"], ["ts", "event_id"], {"best": F.col("value")}, how="max")
    return best.select("experiment", "event_id", "value", F.when(F.col("value").isNotNull(), F.col("best")).alias("best"))


@query(
    "scalar_functions",
    "",
    """
    SELECT event_id, CAST(month(ts) AS INT) AS month, CAST((dayofweek(ts) + 6) % 7 AS INT) AS weekday,
      CAST(dayofyear(ts) AS INT) AS year_day, round(sin(2 * pi() * dayofyear(ts) / 365.25), 6) AS year_sin,
      round(cos(2 * pi() * dayofyear(ts) / 365.25), 6) AS year_cos,
      round(10 * log10(greatest(value / 100, 1e-12)), 4) AS decibel, round((exp(2 * (value / 50 - 1)) - 1) / (exp(2 * (value / 50 - 1)) + 1), 6) AS squashed,
      TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS number
    FROM events
    """,
)
def scalar_functions(spark, folder):
    angle = 2 * F.pi() * F.dayofyear("ts") / 365.25
    return table(spark, folder, "events").select(
        "event_id", F.month("ts").alias("month"), F.weekday("ts").alias("weekday"),
        F.dayofyear("ts").alias("year_day"), F.round(F.sin(angle), 6).alias("year_sin"), F.round(F.cos(angle), 6).alias("year_cos"),
        F.round(10 * F.log10(F.greatest(F.col("value") / 100, F.lit(1e-12))), 4).alias("decibel"),
        F.round(F.tanh(F.col("value") / 50 - 1), 6).alias("squashed"),
        F.when(F.col("event_id") % 4 == 0, F.lit("x")).otherwise(F.col("user_id").cast("string")).try_cast("double").alias("number"),
    )
