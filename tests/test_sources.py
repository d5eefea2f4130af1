"""Ingest jobs and the catalog on written-out payloads."""

import json

import pytest
from pyspark.sql import functions as F

from prismill.sources import payloads as P
from prismill.sources.catalog import Catalog, guard_read_only
from prismill.sources.names import CatalogError, check_name, feed_name, slug


def test_weather(spark):
    good = {"daily": {
        "time": ["2024-01-01", "2024-01-02", "2024-01-03", "soon"], "temperature_2m_max": [10.5, None, "x", 31.0],
        "temperature_2m_min": [1, 2, 3], "precipitation_sum": [0, 0.5, 1], "sunshine_duration": [36000, 0, None]}}
    df = spark.createDataFrame([("東京", json.dumps(good)), ("大阪", '{"reason": "bad date"}')], "city string, payload string")
    rows, rejected = P.weather_rows(df)
    got = rows.orderBy("日付").collect()
    assert [str(r["日付"]) for r in got] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert got[0]["日照時間"] == 10.0 and got[0]["最高気温"] == 10.5 and got[2]["最高気温"] is None
    assert got[0]["都市"] == "東京" and got[0]["平均気温"] is None
    assert sorted(rejected.select("city", "_error").collect()) == [("大阪", "bad date"), ("東京", "no date")]
    assert "31.0" in rejected.where("_error = 'no date'").first()["payload"]


def test_market(spark):
    quote = {k: [1.0, 2.0, None, 4.0] for k in ("open", "high", "low", "volume")} | {"close": [80.0, 84.0, None, 63.0]}
    payload = {"chart": {"error": None, "result": [{
        "meta": {"currency": "NOK", "exchangeTimezoneName": "Europe/Oslo"},
        "timestamp": [1711958400, 1712098800, 1712131200, 1712217600], "indicators": {"quote": [quote]}}]}}
    bad = {"chart": {"error": {"code": "Not Found"}, "result": None}}
    df = spark.createDataFrame([("EQNR.OL", json.dumps(payload)), ("GONE", json.dumps(bad))], "symbol string, payload string")
    rows, rejected = P.market_rows(df)
    got = rows.orderBy("日付").collect()
    assert [str(r["日付"]) for r in got] == ["2024-04-01", "2024-04-03", "2024-04-04"]
    assert got[0]["前日比(%)"] is None
    assert got[2]["前日比(%)"] == pytest.approx(-25.0)
    assert rejected.count() == 1


FEED = """<rss><channel><title>harbour</title>
<item><title>Ferry &amp;amp; pilot strike</title><link>http://harbour/7</link><pubDate>Thu, 15 Aug 2019 21:45:30 +0200</pubDate>
<description>&lt;div&gt;&lt;b&gt;All&lt;/b&gt; boats   stay &lt;br/&gt;moored&lt;/div&gt;</description></item>
<item><title> </title><link>http://harbour/8</link></item>
<item><title>Fog bank</title><link>http://harbour/9</link><pubDate>Fri, 16 Aug 2019 03:00:00 GMT</pubDate></item></channel></rss>"""


def test_feed_and_accumulate(spark):
    df = spark.createDataFrame([("NHK", FEED, "2024-01-03 00:00:00"), ("empty", "<rss><channel/></rss>", "x")],
                               "source string, payload string, fetched_at string")
    rows, rejected = P.feed_rows(df)
    got = P.newest_first(rows).collect()
    assert [r["URL"] for r in got] == ["http://harbour/9", "http://harbour/7"]
    assert got[1]["要約"].split() == ["All", "boats", "stay", "moored"] and got[1]["見出し"] == "Ferry & pilot strike"
    assert str(got[0]["配信日時"]) == "2019-08-16 12:00:00" and str(got[1]["配信日時"]) == "2019-08-16 04:45:30"
    assert sorted(r["_error"] for r in rejected.collect()) == ["no articles", "no title"]
    assert "http://harbour/8" in rejected.where("_error = 'no title'").first()["payload"]
    again = P.accumulate(rows, rows.withColumn("見出し", F.lit("changed")))
    kept = {r["URL"]: r["見出し"] for r in again.collect()}
    assert kept == {"http://harbour/7": "Ferry & pilot strike", "http://harbour/9": "Fog bank"}


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>
<entry><title type="html">Tide &amp;amp; time</title><link rel="self" href="http://b/self"/><link href="http://b/1"/><summary>&lt;i&gt;Low&lt;/i&gt;</summary>
<published>2024-05-01T00:00:00Z</published></entry>
<entry><title>Second</title><link rel="alternate" href="http://b/2"/><content>Body</content><updated>2024-05-02T00:00:00Z</updated></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel><title>f</title></channel><item><title>Third</title><link>http://c/1</link><description>D</description><dc:date>2024-05-03T09:00:00+09:00</dc:date></item></rdf:RDF>"""


def test_other_feed_formats(spark):
    df = spark.createDataFrame([("x", ATOM, "t"), ("y", RDF, "t")], "source string, payload string, fetched_at string")
    rows, rejected = P.feed_rows(df)
    got = [(r["URL"], r["見出し"], r["要約"], str(r["配信日時"])) for r in P.newest_first(rows).collect()]
    assert got == [
        ("http://c/1", "Third", "D", "2024-05-03 09:00:00"), ("http://b/2", "Second", "Body", "2024-05-02 09:00:00"),
        ("http://b/1", "Tide & time", "Low", "2024-05-01 09:00:00"),
    ]
    assert rejected.count() == 0


def test_statistics(spark):
    payload = {"GET_STATS_DATA": {"RESULT": {"STATUS": 0}, "STATISTICAL_DATA": {
        "CLASS_INF": {"CLASS_OBJ": {"@id": "gear", "@name": "漁法", "CLASS": [
            {"@code": "T4", "@name": "底びき網"}, {"@code": "L9", "@name": "はえ縄"}]}},
        "DATA_INF": {"VALUE": [{"@gear": "L9", "@unit": "トン", "$": "41.5"}, {"@gear": "Q0", "@unit": "トン", "$": "…"}]}}}}
    single = json.loads(json.dumps(payload))
    single["GET_STATS_DATA"]["STATISTICAL_DATA"]["DATA_INF"]["VALUE"] = {"@gear": "T4", "@unit": "トン", "$": "880"}
    failed = {"GET_STATS_DATA": {"RESULT": {"STATUS": 3, "ERROR_MSG": "quota used up"}}}
    df = spark.createDataFrame([("a", json.dumps(payload)), ("b", json.dumps(single)), ("c", json.dumps(failed))],
                               "table_id string, payload string")
    rows, rejected = P.statistics_rows(df)
    wide = P.widen_dimensions(rows.orderBy("table_id", "position"), ["漁法"]).collect()
    assert [tuple(r) for r in wide] == [("はえ縄", "トン", 41.5), ("Q0", "トン", None), ("底びき網", "トン", 880.0)]
    assert [r["_error"] for r in rejected.collect()] == ["quota used up"]


def test_statistics_list(spark):
    payload = {"GET_STATS_LIST": {"RESULT": {"STATUS": 0}, "DATALIST_INF": {"TABLE_INF": [
        {"@id": "F7", "STAT_NAME": {"@code": "u", "$": "漁業生産統計"}, "TITLE": "漁獲量", "SURVEY_DATE": 202303, "OVERALL_TOTAL_NUMBER": 52}]}}}
    df = spark.createDataFrame([(json.dumps(payload),)], "payload string")
    assert [tuple(r) for r in P.statistics_tables(df).collect()] == [("F7", "漁業生産統計", "漁獲量", "202303", "52")]


def test_names(spark):
    for bad in ["", "Kelp", "kelp.farm", "kelp farm", "2nd_kelp", "k" * 64, "kelp\n", "_kelp"]:
        with pytest.raises(CatalogError):
            check_name(bad)
    cases = {"GC=F": "market_gc_f", "DX-Y.NYB": "market_dx_y_nyb", "^FTSE": "market_ftse", "Ærø": "market_ærø", "--": "market_asset"}
    df = spark.createDataFrame(list(cases.items()), "s string, want string")
    assert df.where(slug(F.col("s"), "market", "asset") != F.col("want")).count() == 0
    assert feed_name(["nhk"]) == "news_nhk" and feed_name(["a", "b"]) == "news_mixed"


def test_catalog_round_trip(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    df = spark.range(10).withColumn("都市", F.lit("東京"))
    catalog.save("weather_tokyo", df, label="w", source="s", domain="table", params={"city": "tokyo"})
    assert catalog.load("weather_tokyo").count() == 10
    assert catalog.describe("weather_tokyo")["rows"] == 10
    # a dataset may be rebuilt from itself
    catalog.save("weather_tokyo", catalog.load("weather_tokyo").where("id < 4"), label="w", source="s", domain="table")
    reader = catalog.load("weather_tokyo")
    assert reader.count() == 4
    # a reader of the version before still reads it; appended rows are counted
    catalog.save("weather_tokyo", catalog.load("weather_tokyo"), label="w", source="s", domain="table")
    assert reader.count() == 4
    assert catalog.append("weather_tokyo", df.where("id = 9"))["rows"] == catalog.load("weather_tokyo").count() == 5
    assert not [f for f in (tmp_path / "raw").iterdir() if ".meta.json." in f.name and not f.name.endswith(".crc")]
    catalog.save("weather_tokyo", catalog.load("weather_tokyo").where("id < 4"), label="w", source="s", domain="table")
    with pytest.raises(CatalogError):
        catalog.save("nothing", df.where("id < 0"), label="n", source="s", domain="table")
    (tmp_path / "raw" / "broken.meta.json").write_text("{not json")
    (tmp_path / "raw" / "orphan.meta.json").write_text('{"name": "orphan", "path": "/nowhere/x"}')
    assert [r["name"] for r in catalog.list_datasets().collect()] == ["weather_tokyo"]
    assert catalog.query('SELECT `都市`, count(*) AS n FROM weather_tokyo GROUP BY 1').collect() == [("東京", 4)]
    assert catalog.query("SUMMARIZE weather_tokyo").count() == 2
    with pytest.raises(CatalogError):
        catalog.query("DROP VIEW weather_tokyo")
    catalog.delete("weather_tokyo")
    catalog.delete("weather_tokyo")
    with pytest.raises(CatalogError):
        catalog.load("weather_tokyo")


@pytest.mark.parametrize("sql", [
    "MERGE INTO ledger USING fresh ON ledger.id = fresh.id WHEN MATCHED THEN DELETE", "TRUNCATE TABLE ledger", "CACHE TABLE ledger",
    "REFRESH TABLE ledger", "ALTER TABLE ledger ADD COLUMN extra INT", "SET spark.sql.ansi.enabled = false", "USE elsewhere",
    "ANALYZE TABLE ledger COMPUTE STATISTICS", "EXPLAIN TABLE ledger", "SELECT id FROM ledger; TRUNCATE TABLE ledger", "", ";", "(((",
    "SUMMARIZE TRUNCATE TABLE ledger", "WITH old AS (TABLE ledger) INSERT OVERWRITE ledger SELECT * FROM old", "FROM fresh INSERT INTO ledger SELECT id",
    "SELECT reflect('java.lang.Runtime', 'getRuntime')", "TABLE ledger |> WHERE try_reflect ('a.B', 'c')"])
def test_guard_rejects(spark, sql):
    with pytest.raises(CatalogError):
        guard_read_only(spark, sql)


@pytest.mark.parametrize("sql", [
    "SELECT ';' AS mark", "TABLE ledger;", "FROM ledger SELECT id", "WITH old AS (TABLE ledger) SELECT count(*) FROM old", "(SELECT 1) UNION ALL (SELECT 2)",
    "DESCRIBE ledger", "SHOW TABLES", "SHOW COLUMNS IN ledger", "SUMMARIZE ledger;", "SUMMARIZE SELECT id FROM ledger", "VALUES (1), (2)"])
def test_guard_allows(spark, sql):
    assert guard_read_only(spark, sql) == sql
