"""Landed API payloads to tidy rows, as DataFrame jobs over files.

Each job reads one payload per row (a string column), so ten thousand landed files spread over
the cluster. Rows that cannot be used go to a second frame with the reason in ``_error``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismill.operators.ordering import first_per_key


class Ingested(NamedTuple):
    rows: DataFrame
    rejected: DataFrame


# Payload variable -> output column.
WEATHER_COLUMNS = {
    "temperature_2m_max": "最高気温",
    "temperature_2m_min": "最低気温",
    "temperature_2m_mean": "平均気温",
    "precipitation_sum": "降水量",
    "windspeed_10m_max": "最大風速",
    "sunshine_duration": "日照時間",
}
_TEXTS = T.ArrayType(T.StringType())
_WEATHER = T.StructType(
    [
        T.StructField("daily", T.StructType([T.StructField(c, _TEXTS) for c in ("time", *WEATHER_COLUMNS)])),
        T.StructField("reason", T.StringType()),
    ]
)


def weather_rows(payloads: DataFrame, payload: str = "payload", city: str = "city") -> Ingested:
    """Parallel daily arrays to one row per day and city; bad numbers become null, seconds of sun hours."""
    parsed = payloads.withColumn("_p", F.from_json(payload, _WEATHER))
    usable = F.coalesce(F.size("_p.daily.time"), F.lit(0)) > 0
    # array variables the payload lacks become nulls next to each day
    arrays = [F.coalesce(F.col(f"_p.daily.{c}"), F.array().cast(_TEXTS)).alias(c) for c in ("time", *WEATHER_COLUMNS)]
    days = parsed.where(usable).select(city, *arrays)
    days = days.select(city, F.inline(F.arrays_zip("time", *WEATHER_COLUMNS)))
    values = []
    for name, label in WEATHER_COLUMNS.items():
        value = F.col(name).try_cast("double")
        values.append((value / 3600 if name == "sunshine_duration" else value).alias(label))
    rows = days.select(F.col("time").try_cast("date").alias("日付"), F.col(city).alias("都市"), *values)
    reason = F.coalesce(F.col("_p.reason"), F.lit("no daily data"))
    rejected = parsed.where(~usable).select(city, F.col(payload), reason.alias("_error"))
    # a day whose date can't be read is handed back by itself
    dated = F.col("time").try_cast("date").isNotNull()
    undated = days.where(~dated).select(city, F.to_json(F.struct("time", *WEATHER_COLUMNS)).alias(payload), F.lit("no date").alias("_error"))
    return Ingested(rows.where(F.col("日付").isNotNull()), rejected.union(undated))


_SERIES = T.ArrayType(T.DoubleType())
_MARKET = T.StructType(
    [
        T.StructField(
            "chart",
            T.StructType(
                [
                    T.StructField("error", T.StringType()),
                    T.StructField(
                        "result",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField(
                                        "meta",
                                        T.StructType(
                                            [T.StructField("currency", T.StringType()), T.StructField("exchangeTimezoneName", T.StringType())]
                                        ),
                                    ),
                                    T.StructField("timestamp", T.ArrayType(T.LongType())),
                                    T.StructField(
                                        "indicators",
                                        T.StructType(
                                            [
                                                T.StructField(
                                                    "quote",
                                                    T.ArrayType(
                                                        T.StructType(
                                                            [T.StructField(c, _SERIES) for c in ("open", "high", "low", "close", "volume")]
                                                        )
                                                    ),
                                                )
                                            ]
                                        ),
                                    ),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        )
    ]
)


def market_rows(payloads: DataFrame, payload: str = "payload", symbol: str = "symbol") -> Ingested:
    """Epoch and price arrays to one row per trading day, with the change against the previous kept close."""
    parsed = payloads.withColumn("_p", F.from_json(payload, _MARKET).getField("chart"))
    parsed = parsed.withColumn("_r", F.try_element_at("_p.result", F.lit(1))).withColumn(
        "_q", F.try_element_at("_r.indicators.quote", F.lit(1))
    )
    failed = F.col("_p.error").isNotNull()
    usable = F.coalesce(~failed & (F.size("_r.timestamp") > 0), F.lit(False))
    zone = F.coalesce("_r.meta.exchangeTimezoneName", F.lit("UTC"))
    names = ("open", "high", "low", "close", "volume")
    arrays = [F.coalesce(F.col(f"_q.{c}"), F.array().cast(_SERIES)).alias(c) for c in names]
    bars = parsed.where(usable).select(F.col(symbol), zone.alias("_zone"), F.col("_r.timestamp").alias("t"), *arrays)
    bars = bars.select(symbol, "_zone", F.inline(F.arrays_zip("t", *names)))
    # seconds since 1970 read as UTC, then shown on the exchange's wall clock
    utc = F.timestamp_seconds("t")
    local = F.convert_timezone(F.lit("UTC"), F.col("_zone"), _as_utc_clock(utc))
    rows = bars.where(F.col("close").isNotNull() & ~F.isnan("close") & F.col("t").isNotNull())
    rows = rows.select(local.cast("date").alias("日付"), F.col(symbol).alias("銘柄"), "t", *names)
    previous = F.lag("close").over(Window.partitionBy("銘柄").orderBy("t"))
    rows = rows.select(
        "日付", "銘柄", F.col("open").alias("始値"), F.col("high").alias("高値"), F.col("low").alias("安値"),
        F.col("close").alias("終値"), F.col("volume").alias("出来高"), ((F.col("close") / previous - 1) * 100).alias("前日比(%)"),
    )
    why = F.when(failed, F.lit("unknown symbol")).otherwise("no data")
    return Ingested(rows, parsed.where(~usable).select(symbol, payload, why.alias("_error")))


def _as_utc_clock(instant: Column) -> Column:
    """An instant as the zone-free clock reading in UTC, whatever the session zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


# The character references feeds use, the ampersand last.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&#160;": " ", "&amp;": "&",
}


def clean_markup(text: Column) -> Column:
    """Drop tags, resolve character references, collapse white space."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    for reference, plain in ENTITIES.items():
        out = F.replace(out, F.lit(reference), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"[\s ]+", " "))


# items of the three feed formats: below the channel, beside it, and entries with their links as attributes
_ITEM = "ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, pubDate: STRING, updated: STRING, date: STRING>>"
_ENTRY = (
    "ARRAY<STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>, summary: STRING, content: STRING, "
    "published: STRING, updated: STRING>>"
)
_FEED = f"channel STRUCT<item: {_ITEM}>, item {_ITEM}, entry {_ENTRY}"


def _feed_items(parsed: Column) -> Column:
    """Title, link, description and times of every item, whatever the format."""
    texts = "title", "link", "description", "pubDate", "updated"

    def rss(item: Column) -> Column:
        return F.struct(*[item[c].alias(c) for c in texts[:4]], F.coalesce(item["updated"], item["date"]).alias("updated"))

    def atom(entry: Column) -> Column:
        page = F.filter(entry["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
        return F.struct(
            entry["title"].alias("title"), F.get(F.coalesce(page, entry["link"]), F.lit(0))["_href"].alias("link"),
            F.coalesce(entry["summary"], entry["content"]).alias("description"), entry["published"].alias("pubDate"), entry["updated"].alias("updated"),
        )

    none = F.array().cast("array<struct<title: string, link: string, description: string, pubDate: string, updated: string>>")
    lists = (F.transform(parsed["channel"]["item"], rss), F.transform(parsed["item"], rss), F.transform(parsed["entry"], atom))
    return F.concat(*[F.coalesce(x, none) for x in lists])


FEED_ZONE = "Asia/Tokyo"


def _feed_time(text: Column) -> Column:
    """RFC 822 or ISO time to the zone-free clock of the feed zone."""
    rfc = F.try_to_timestamp(F.regexp_replace(text, r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss xx"))
    named = F.try_to_timestamp(
        F.regexp_replace(F.regexp_replace(text, r"^\w{3},\s*", ""), r"\s(GMT|UTC|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss xx")
    )
    iso = F.try_to_timestamp(text)
    return F.convert_timezone(F.lit("UTC"), F.lit(FEED_ZONE), _as_utc_clock(F.coalesce(rfc, named, iso)))


def feed_rows(payloads: DataFrame, payload: str = "payload", source: str = "source", fetched_at: str = "fetched_at") -> Ingested:
    """Feed documents (RSS 2.0, RSS 1.0, Atom) to articles; items without a title are handed back as rejected."""
    parsed = payloads.withColumn("_items", _feed_items(F.from_xml(payload, _FEED, {"ignoreNamespace": "true"})))
    usable = F.size("_items") > 0
    items = parsed.where(usable).select(source, fetched_at, F.inline("_items"))
    rows = items.select(
        F.col(source).alias("配信元"),
        F.coalesce(_feed_time(F.col("pubDate")), _feed_time(F.col("updated"))).alias("配信日時"),
        clean_markup(F.col("title")).alias("見出し"),
        clean_markup(F.col("description")).alias("要約"),
        F.coalesce("link", F.lit("")).alias("URL"),
        F.col(fetched_at).alias("取得日時"),
    )
    rejected = parsed.where(~usable).select(source, payload, F.lit("no articles").alias("_error"))
    untitled = F.coalesce(clean_markup(F.col("title")), F.lit("")) == ""
    lost = items.where(untitled).select(
        source, F.to_json(F.struct("title", "link", "description", "pubDate", "updated")).alias(payload), F.lit("no title").alias("_error")
    )
    return Ingested(rows.where(F.col("見出し") != ""), rejected.union(lost))


def newest_first(articles: DataFrame) -> DataFrame:
    """Articles for reading: the latest first, undated ones last."""
    return articles.orderBy(F.desc_nulls_last("配信日時"), "URL")


def accumulate(saved: DataFrame | None, fresh: DataFrame, key: str = "URL", position: str | None = None) -> DataFrame:
    """Saved rows and fresh rows, the first row per key kept; a saved row wins over a fresh one.

    Among rows of one batch the smallest ``position`` (else the smallest row content) is first.
    """
    batches = fresh.withColumn("_batch", F.lit(1))
    if saved is not None:
        batches = saved.withColumn("_batch", F.lit(0)).unionByName(batches, allowMissingColumns=True)
    ties = [position] if position else [c for c in fresh.columns if c != key]
    return first_per_key(batches, [key], ["_batch", *ties]).drop("_batch")


# --- official statistics --------------------------------------------------------


def _listed(node: str) -> str:
    """A JSON path whose node may be one object or a list of them, as an array of variants."""
    return (
        f"CASE WHEN schema_of_variant({node}) LIKE 'ARRAY%' THEN CAST({node} AS ARRAY<VARIANT>) "
        f"WHEN {node} IS NOT NULL AND NOT is_variant_null({node}) THEN array({node}) ELSE array() END"
    )


def _node_text(node: str) -> str:
    """Text that may be a plain value or sit under ``$``."""
    inner = f"try_variant_get({node}, '$[\"$\"]', 'string')"
    return f"CASE WHEN schema_of_variant({node}) LIKE 'OBJECT%' THEN coalesce({inner}, '') ELSE coalesce(try_cast({node} AS STRING), '') END"


def statistics_rows(payloads: DataFrame, payload: str = "payload", table_id: str = "table_id") -> Ingested:
    """Statistics values in long form: one row per value and dimension-label pair set.

    Output: table id, position, map of dimension name to label, unit and value. Codes are
    replaced by their names where the class list knows them and kept where it does not.
    """
    parsed = payloads.withColumn("_v", F.try_parse_json(payload))
    root = "try_variant_get(_v, '$.GET_STATS_DATA', 'variant')"
    status = "coalesce(try_variant_get(_v, '$.GET_STATS_DATA.RESULT.STATUS', 'int'), -1)"
    values = _listed("_values")
    parsed = parsed.selectExpr(
        "*", f"{status} AS _status",
        "try_variant_get(_v, '$.GET_STATS_DATA.STATISTICAL_DATA.DATA_INF.VALUE', 'variant') AS _values",
        "try_variant_get(_v, '$.GET_STATS_DATA.STATISTICAL_DATA.CLASS_INF.CLASS_OBJ', 'variant') AS _classes",
        f"try_variant_get({root}, '$.RESULT.ERROR_MSG', 'string') AS _message",
    ).selectExpr("*", f"{values} AS _list")
    usable = (F.col("_status") == 0) & (F.size("_list") > 0)
    cells = (
        parsed.where(usable)
        .select(table_id, F.posexplode("_list").alias("position", "_cell"))
        .select(table_id, "position", F.expr("CAST(_cell AS MAP<STRING, VARIANT>)").alias("_m"))
        .select(table_id, "position", F.expr("transform_values(_m, (k, v) -> CAST(v AS STRING))").alias("_m"))
    )
    dims = cells.select(table_id, "position", F.explode("_m").alias("attribute", "code")).where(
        F.col("attribute").startswith("@") & (F.col("attribute") != "@unit")
    )
    objects = parsed.where(usable).selectExpr(table_id, f"explode({_listed('_classes')}) AS _o").selectExpr(
        table_id,
        "concat('@', try_variant_get(_o, '$[\"@id\"]', 'string')) AS attribute",
        "try_variant_get(_o, '$[\"@name\"]', 'variant') AS _n",
        "try_variant_get(_o, '$.CLASS', 'variant') AS _c",
    ).selectExpr(
        table_id, "attribute", f"coalesce(nullif({_node_text('_n')}, ''), substring(attribute, 2)) AS dimension", f"{_listed('_c')} AS _c"
    )
    names = objects.select(table_id, "attribute", F.explode("_c").alias("_e")).selectExpr(
        table_id, "attribute", "try_variant_get(_e, '$[\"@code\"]', 'string') AS code",
        "try_variant_get(_e, '$[\"@name\"]', 'variant') AS _n",
    ).selectExpr(table_id, "attribute", "code", f"{_node_text('_n')} AS label").dropDuplicates([table_id, "attribute", "code"])
    labelled = dims.join(objects.select(table_id, "attribute", "dimension"), [table_id, "attribute"]).join(
        names, [table_id, "attribute", "code"], "left"
    )
    # one value has one entry per class object: a handful
    pairs = labelled.groupBy(table_id, "position").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("dimension", F.coalesce("label", "code"))))).alias("dimensions")
    )
    rows = cells.join(pairs, [table_id, "position"], "left").select(
        table_id, "position", F.coalesce("dimensions", F.create_map().cast("map<string,string>")).alias("dimensions"),
        F.try_element_at("_m", F.lit("@unit")).alias("単位"), F.try_element_at("_m", F.lit("$")).try_cast("double").alias("値"),
    )
    why = F.coalesce("_message", F.lit("no values"))
    return Ingested(rows, parsed.where(~usable).select(table_id, payload, why.alias("_error")))


def widen_dimensions(rows: DataFrame, names: list[str]) -> DataFrame:
    """One column per named dimension of a statistics table."""
    columns = [F.try_element_at("dimensions", F.lit(n)).alias(n) for n in names]
    return rows.select(*columns, "単位", "値")


def statistics_tables(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The list of statistics tables a search returned."""
    parsed = payloads.select(F.try_parse_json(payload).alias("_v")).selectExpr(
        "try_variant_get(_v, '$.GET_STATS_LIST.DATALIST_INF.TABLE_INF', 'variant') AS _t",
        "coalesce(try_variant_get(_v, '$.GET_STATS_LIST.RESULT.STATUS', 'int'), -1) AS _status",
    )
    nodes = {"統計名": "STAT_NAME", "表題": "TITLE", "調査年月": "SURVEY_DATE"}
    tables = parsed.where("_status = 0").selectExpr(f"explode({_listed('_t')}) AS _e").selectExpr(
        "coalesce(try_variant_get(_e, '$[\"@id\"]', 'string'), '') AS `統計表ID`",
        *[f"try_variant_get(_e, '$.{path}', 'variant') AS _{path}" for path in nodes.values()],
        "coalesce(try_variant_get(_e, '$.OVERALL_TOTAL_NUMBER', 'string'), '') AS `行数`",
    )
    return tables.selectExpr("`統計表ID`", *[f"{_node_text('_' + path)} AS `{name}`" for name, path in nodes.items()], "`行数`")


def label_targets(df: DataFrame, target: str, labels: list[str], out: str) -> DataFrame:
    """Replace integer classes by their names; the name list is a handful of literals."""
    names = F.array(*[F.lit(name) for name in labels])
    return df.withColumn(out, F.try_element_at(names, F.col(target).cast("int") + 1))
