"""Ingest queries over payloads that Spark builds from the tables, so that the parsers meet every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismill.functions.rounding import settled, settled_sql
from prismill.plans.registry import query, table
from prismill.sources import payloads as P


def weather_payloads(spark, folder):
    """One payload per ship month: its days, with prices as temperatures; every seventh maximum is not a number."""
    days = table(spark, folder, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(
        F.max("l_extendedprice").alias("hi"), F.min("l_extendedprice").alias("lo"), F.avg("l_extendedprice").alias("mid"), F.sum("l_quantity").alias("sun")
    )
    high = F.when(F.day("d") % 7 == 0, F.lit("bad")).otherwise(F.col("hi").cast("string"))
    row = F.struct(
        "d", high.alias("hi"), F.col("lo").cast("string").alias("lo"), F.col("mid").cast("string").alias("mid"), F.col("sun").cast("string").alias("sun")
    )
    # at most 31 days per payload
    months = days.groupBy(F.date_format("d", "yyyy-MM").alias("city")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    daily = F.struct(
        F.transform("r.d", lambda d: d.cast("string")).alias("time"), F.col("r.hi").alias("temperature_2m_max"),
        F.col("r.lo").alias("temperature_2m_min"), F.col("r.mid").alias("temperature_2m_mean"), F.col("r.sun").alias("sunshine_duration"),
    )
    return months.select("city", F.to_json(F.struct(daily.alias("daily"))).alias("payload"))


@query(
    "weather_payload_rows",
    "C17",
    f"""
    WITH d AS (SELECT CAST(l_shipdate AS DATE) AS d, max(l_extendedprice) AS hi, min(l_extendedprice) AS lo, avg(l_extendedprice) AS mid, sum(l_quantity) AS sun FROM lineitem GROUP BY 1)
    SELECT strftime(d, '%Y-%m-%d') AS "日付", strftime(d, '%Y-%m') AS "都市", CASE WHEN extract('day' FROM d) % 7 <> 0 THEN hi END AS "最高気温", lo AS "最低気温",
      {settled_sql('mid', 3)} AS "平均気温", CAST(NULL AS DOUBLE) AS "降水量", CAST(NULL AS DOUBLE) AS "最大風速", round(sun / 3600, 8) AS "日照時間" FROM d
    """,
)
def weather_payload_rows(spark, folder):
    rows = P.weather_rows(weather_payloads(spark, folder)).rows
    return rows.select(
        F.date_format("日付", "yyyy-MM-dd").alias("日付"), "都市", "最高気温", "最低気温", settled("平均気温", 3), "降水量", "最大風速", F.round("日照時間", 8).alias("日照時間")
    )


def market_payloads(spark, folder):
    """One payload per return flag with its daily prices; closes of the 13th are null."""
    days = table(spark, folder, "lineitem").groupBy("l_returnflag", F.col("l_shipdate").cast("date").alias("d")).agg(
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.sum("l_quantity").alias("volume")
    )
    close = F.when(F.day("d") != 13, (F.col("low") + F.col("high")) / 2)
    seconds = (F.datediff("d", F.lit("1970-01-01")) * 86400 + 3600).cast("bigint").alias("t")
    row = F.struct(seconds, F.col("low").alias("open"), "high", "low", close.alias("close"), "volume")
    # days of one flag: bounded by the time span
    flags = days.groupBy(F.col("l_returnflag").alias("symbol")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    quote = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    result = F.struct(
        F.struct(F.lit("JPY").alias("currency"), F.lit("Asia/Tokyo").alias("exchangeTimezoneName")).alias("meta"),
        F.col("r.t").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"),
    )
    chart = F.struct(F.struct(F.array(result).alias("result")).alias("chart"))
    return flags.select("symbol", F.to_json(chart, {"ignoreNullFields": "false"}).alias("payload"))


@query(
    "market_payload_rows",
    "C18 W09",
    """
    WITH d AS (SELECT l_returnflag AS s, CAST(l_shipdate AS DATE) AS d, (min(l_extendedprice) + max(l_extendedprice)) / 2 AS c, max(l_extendedprice) AS h, sum(l_quantity) AS v
      FROM lineitem GROUP BY 1, 2), k AS (SELECT * FROM d WHERE extract('day' FROM d) <> 13)
    SELECT s AS "銘柄", strftime(d, '%Y-%m-%d') AS "日付", round(c + 1.23e-6, 3) AS "終値", h AS "高値", v AS "出来高",
      round(100 * (c / lag(c) OVER (PARTITION BY s ORDER BY d) - 1), 6) AS "前日比(%)" FROM k
    """,
)
def market_payload_rows(spark, folder):
    rows = P.market_rows(market_payloads(spark, folder)).rows
    return rows.select(
        "銘柄", F.date_format("日付", "yyyy-MM-dd").alias("日付"), settled("終値", 3), "高値", "出来高", F.round("前日比(%)", 6).alias("前日比(%)")
    )


def feed_payloads(spark, folder):
    """One feed document per 50 documents, their first word sequence escaped into a summary with markup."""
    words = F.regexp_replace(F.regexp_replace("text", r"[^\p{L} ]", " "), " +", " ")
    day = F.date_add(F.lit("2024-01-01"), (F.col("doc_id") % 300).cast("int"))
    stamp = F.concat(F.date_format(day, "dd MMM yyyy"), F.lit(" 00:00:00 GMT"))
    item = F.concat(
        F.lit("<item><title>doc "), F.col("doc_id"), F.lit("</title><link>http://docs/"), (F.col("doc_id") % 700).cast("string"),
        F.lit("</link><description>&lt;p&gt;"), words, F.lit("&lt;/p&gt;</description>"),
        F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("<pubDate>"), stamp, F.lit("</pubDate>"))).otherwise(""), F.lit("</item>"),
    )
    groups = table(spark, folder, "documents").groupBy(F.floor(F.col("doc_id") / 50).alias("batch")).agg(
        F.array_join(F.collect_list(item), "").alias("items")
    )
    return groups.select(
        F.concat(F.lit("feed "), F.col("batch")).alias("source"), F.concat(F.lit("<rss><channel>"), F.col("items"), F.lit("</channel></rss>")).alias("payload"),
        F.lit("2024-12-01").alias("fetched_at"),
    )


_FEED = r"""f AS (SELECT doc_id, 'feed ' || (doc_id // 50) AS "配信元", CASE WHEN doc_id % 9 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INT), '%Y-%m-%d') || ' 09:00:00' END AS "配信日時",
    'doc ' || doc_id AS "見出し", trim(regexp_replace(regexp_replace(text, '[^\p{L} ]', ' ', 'g'), ' +', ' ', 'g')) AS "要約", 'http://docs/' || (doc_id % 700) AS "URL" FROM documents)"""


@query("feed_payload_rows", "C19 O02", f'WITH {_FEED} SELECT "配信元", "配信日時", "見出し", "要約", "URL" FROM f')
def feed_payload_rows(spark, folder):
    rows = P.feed_rows(feed_payloads(spark, folder)).rows
    return rows.select("配信元", F.date_format("配信日時", "yyyy-MM-dd HH:mm:ss").alias("配信日時"), "見出し", "要約", "URL")


@query(
    "accumulated_feed",
    "C20 U02",
    f"""WITH {_FEED}, r AS (SELECT *, row_number() OVER (PARTITION BY "URL" ORDER BY CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END, doc_id) AS r FROM f)
    SELECT "見出し", "URL" FROM r WHERE r = 1""",
)
def accumulated_feed(spark, folder):
    """Even documents were saved before; all documents arrive again."""
    rows = P.feed_rows(feed_payloads(spark, folder)).rows
    numbered = rows.select("見出し", "URL", F.regexp_extract("見出し", r"(\d+)", 1).cast("bigint").alias("position"))
    saved = numbered.where("position % 2 = 0")
    return P.accumulate(saved, numbered, "URL", "position").select("見出し", "URL")


def statistics_payloads(spark, folder):
    """One payload per order priority: order counts by status and year, with a class list for the statuses."""
    counts = table(spark, folder, "orders").groupBy("o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    value = F.concat(
        F.lit('{"@cat01":"'), F.col("o_orderstatus"), F.lit('","@time":"'), F.col("y"), F.lit('","@unit":"件","$":"'),
        F.when(F.col("y") == 1999, F.lit("-")).otherwise(F.col("n").cast("string")), F.lit('"}'),
    )
    # a priority has one value per status and year
    groups = counts.groupBy(F.col("o_orderpriority").alias("table_id")).agg(F.array_join(F.sort_array(F.collect_list(value)), ",").alias("v"))
    classes = (
        '{"CLASS_OBJ":[{"@id":"cat01","@name":"status","CLASS":[{"@code":"F","@name":"finished"},{"@code":"O","@name":"open"}]},'
        '{"@id":"time","@name":"year","CLASS":{"@code":"1995","@name":"year 1995"}}]}'
    )
    whole = F.concat(
        F.lit('{"GET_STATS_DATA":{"RESULT":{"STATUS":0},"STATISTICAL_DATA":{"CLASS_INF":' + classes + ',"DATA_INF":{"VALUE":['), F.col("v"), F.lit("]}}}}")
    )
    return groups.select("table_id", whole.alias("payload"))


@query(
    "statistics_payload_rows",
    "C21 J02",
    """
    SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status,
      CASE WHEN year(o_orderdate) = 1995 THEN 'year 1995' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year, '件' AS "単位",
      CASE WHEN year(o_orderdate) <> 1999 THEN CAST(count(*) AS DOUBLE) END AS "値"
    FROM orders GROUP BY o_orderpriority, o_orderstatus, year(o_orderdate)
    """,
)
def statistics_payload_rows(spark, folder):
    rows = P.statistics_rows(statistics_payloads(spark, folder)).rows
    return P.widen_dimensions(rows, ["status", "year"])


@query(
    "statistics_table_list",
    "C22",
    """SELECT CAST(p_partkey AS VARCHAR) AS "統計表ID", p_brand AS "統計名", p_name AS "表題", CAST(p_size AS VARCHAR) AS "調査年月", CAST(p_partkey * 3 AS VARCHAR) AS "行数" FROM part""",
)
def statistics_table_list(spark, folder):
    """One search answer per 20 parts."""
    entry = F.concat(
        F.lit('{"@id":"'), F.col("p_partkey"), F.lit('","STAT_NAME":{"@code":"1","$":"'), F.col("p_brand"), F.lit('"},"TITLE":"'), F.col("p_name"),
        F.lit('","SURVEY_DATE":'), F.col("p_size"), F.lit(',"OVERALL_TOTAL_NUMBER":'), F.col("p_partkey") * 3, F.lit("}"),
    )
    groups = table(spark, folder, "part").groupBy(F.floor(F.col("p_partkey") / 20).alias("g")).agg(F.array_join(F.collect_list(entry), ",").alias("t"))
    whole = F.concat(F.lit('{"GET_STATS_LIST":{"RESULT":{"STATUS":0},"DATALIST_INF":{"TABLE_INF":['), F.col("t"), F.lit("]}}}"))
    return P.statistics_tables(groups.select(whole.alias("payload")))
