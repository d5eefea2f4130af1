"""Landed feed files accumulate across runs without duplicates."""

from prismill.sources.catalog import Catalog
from prismill.streaming.feeds import accumulate_landed

ITEM = "<item><title>t{0}</title><link>http://a/{0}</link><description>d</description></item>"


def feed(*ids):
    return "<rss><channel>" + "".join(ITEM.format(i) for i in ids) + "</channel></rss>"


def test_two_runs(spark, tmp_path):
    landed = tmp_path / "landed" / "nhk"
    landed.mkdir(parents=True)
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    run = lambda: accumulate_landed(spark, catalog, str(tmp_path / "landed"), "news_nhk", str(tmp_path / "state"))
    (landed / "1.xml").write_text(feed(1, 2))
    run()
    assert catalog.load("news_nhk").count() == 2
    (landed / "2.xml").write_text(feed(2, 3))
    run()
    run()
    rows = catalog.load("news_nhk").collect()
    assert sorted(r["URL"] for r in rows) == ["http://a/1", "http://a/2", "http://a/3"]
    assert {r["配信元"] for r in rows} == {"nhk"}
