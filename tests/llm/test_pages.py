"""URL filter, page text and fingerprints."""

import hashlib

import pytest

from prismill.llm import minhash, template, urlfilter
from prismill.llm.urlfilter import Rule
from tests.llm.articles import AWKWARD, articles, collected

RULES = [Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/")]


def test_longest_rule_decides_and_blocks_reach_aliases(spark):
    urls = [
        "https://a.example.com/en/1", "http://WWW.Example.com/en/1?x=/en/", "https://b.org/x#top", "https://c.org/y", "https://d.net/es/1",
        "https://d.net/de/1", "https://e.com/z", "notes.com/en/", "ftp://f.com", "https://xcom/", None, "https://b.org/x", "https://lonely.org/",
    ]
    links = spark.createDataFrame(
        [("https://d.net/es/1", "https://c.org/y"), ("https://c.org/y", "https://b.org/x"), ("https://b.org/x", "https://e.com/z"),
         ("https://lonely.org/", "https://d.net/de/1"), (None, "https://lonely.org/"), ("https://c.org/y", "https://c.org/y")], "a string, b string",
    )
    df = spark.createDataFrame([(u, "x", "y") for u in urls], "URL string, host string, address string")
    got = {r["URL"]: r for r in urlfilter.judge_urls(df, RULES, links).collect()}
    want = {
        urls[0]: ("example.com/en/", "block"), urls[1]: ("www.example.com/en/", "allow"), urls[2]: (None, "block"), urls[3]: (None, "block"),
        urls[4]: ("net/es/", "block"), urls[5]: (None, "allow"), urls[6]: ("com/", "allow"), urls[7]: (None, "allow"), urls[8]: (None, "allow"),
        urls[9]: (None, "allow"), None: (None, "allow"), urls[11]: (None, "block"), urls[12]: (None, "allow"),
    }
    assert {u: (r["rule"], r["verdict"]) for u, r in got.items()} == want
    assert (got[urls[1]]["host"], got[urls[1]]["path"]) == ("www.example.com", "/en/1")
    assert (got[urls[7]]["host"], got[None]["path"], got[urls[8]]["path"]) == ("", "", "")
    assert urlfilter.judge_urls(df.limit(0), RULES, links.limit(0)).count() == 0
    assert urlfilter.judge_urls(df, RULES).count() == len(urls)


def test_links_of_pages(spark):
    pages = [
        ("http://Site.org/a/b#x", '<head><link rel="canonical" href="/c?d=1&amp;e=2"></head>'),
        ("http://site.org/a/b", "<LINK HREF='d' REL=canonical>"),
        ("http://site.org/r", '<meta http-equiv="refresh" content="0; url=https://Other.net/q#f">'),
        ("http://site.org/n", '<link rel="stylesheet" href="s.css"><meta name="x" content="url=zz">'),
        ("http://site.org", "<link href=//cdn.org/k rel='nofollow canonical'>"), (None, '<link rel="canonical" href="/c">'), ("http://site.org/e", None),
    ]
    df = spark.createDataFrame(pages, "URL string, html string")
    got = sorted((r["a"], r["b"]) for r in urlfilter.page_links(df).collect())
    assert got == sorted([
        ("http://site.org/a/b", "http://site.org/c?d=1&e=2"), ("http://site.org/a/b", "http://site.org/a/d"),
        ("http://site.org/r", "https://other.net/q"), ("http://site.org", "http://cdn.org/k"),
    ])


ARTICLE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav>"
    "<div class='ad'>Buy now</div><article><h1>Head &amp; line</h1><p><b>First\n  part<br>of it<p>Second&nbsp;part &lt;3</p><ul><li>One<li>Two</ul>"
    "<section class='comments'><p>A reader says</p></section><form><p>Mail</p></form></article><aside>Side</aside><footer>&copy; me</footer></body></html>"
)


def test_article_element_is_extracted():
    text = template.main_text(template.read_page(ARTICLE), set(), set())
    assert text == "Head & line\n\nFirst part of it\n\nSecond part <3\n\nOne\n\nTwo"


@pytest.mark.parametrize("page, want", [
    ("", ""), ("just text", "just text"), ("<p>open <b>only", "open only"), ("a < b & c", "a < b & c"), ("<script>x", ""), ("<!-- <p>no</p> --><p>yes", "yes"),
    ("<p title='a>b'>quoted</p>", "quoted"), ("<div hidden>no</div><p>yes</p>", "yes"), ("</div></p>stray</p>", "stray"),
    ("<p>a<span class='ad'>buy</span> b</p><button>no</button><script>if(a<b){x=\"it's\"}</script><p>c", "a b\n\nc"), ("<a class=share href=x>s</a><p>z", "z"),
    ("<main><header><h1>T</h1></header><p>x</p></main><p>after</p>", "T\n\nx"),
])
def test_odd_markup(page, want):
    assert template.main_text(template.read_page(page), set(), set()) == want


def _site(host, i):
    links = "".join(f"<li><a href='/{k}'>Part {k}</a></li>" for k in range(i % 3 + 2))
    return (
        f"http://{host}/{i}",
        f"<body><div><ul>{links}</ul></div><div>All the news of {host}</div><div><h2>Story {i}</h2><p>What happened on day {i} is told here.</p></div>"
        f"<div>Imprint of {host}</div></body>",
    )


def test_template_of_a_host_without_article_elements(spark):
    rows = [_site("one.org", i) for i in range(6)] + [_site("two.org", i) for i in range(4)] + [_site("single.org", 0)]
    df = spark.createDataFrame([(u, h, "x", "y") for u, h in rows], "URL string, html string, host string, text string")
    got = {r["URL"]: r["text"] for r in template.extract_articles(df).collect()}
    for u, _ in rows[:-1]:
        i = u.rpartition("/")[2]
        assert got[u] == f"Story {i}\n\nWhat happened on day {i} is told here."
    assert "Story 0" in got["http://single.org/0"]


def test_copies_of_one_page_keep_their_text(spark):
    df = spark.createDataFrame([(f"http://c.org/{i}", ARTICLE) for i in range(5)] + [("http://c.org/5", None), (None, ARTICLE), (None, ARTICLE), ("http://c.org/0", ARTICLE)], "URL string, html string")
    rows = collected(template.extract_articles(df))
    assert len(rows) == 9
    assert {r["text"] for r in rows} == {"", "Head & line\n\nFirst part of it\n\nSecond part <3\n\nOne\n\nTwo"}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert template.extract_articles(df.limit(0)).count() == 0


def test_template_reaches_into_articles(spark):
    """Texts fixed by the host's template are no article text, whatever element they are in; what leaves the order of its class stays."""
    def page(i):
        lines = ["<p>First note</p>", "<p>Second note</p>"][:: 1 if i % 2 else -1]
        promo = "<div><p>Read more on our site</p></div>" if i % 3 else ""
        return f"<html><body><article><h1>Story {i}</h1><p>Told on day {i}.</p>{promo}<section><p>All rights reserved</p></section>{''.join(lines)}</article></body></html>"

    rows = [(f"http://t.org/{i}", page(i)) for i in range(9)] * 2 + [("http://other.org/x", "<article><p>Read more on our site")]
    df = spark.createDataFrame(rows, "URL string, html string")
    out = template.extract_articles(df).collect()
    assert len(out) == len(rows)
    for r in out[:18]:
        i = int(r["URL"].rpartition("/")[2]) if r["URL"][-1] != "x" else None
        if i is not None:
            first, second = ("First note", "Second note")[:: 1 if i % 2 else -1]
            blocks = r["text"].split("\n\n")
            assert blocks[:2] == [f"Story {i}", f"Told on day {i}."] and "All rights reserved" not in blocks and "Read more on our site" not in blocks
            assert {first, second} & set(blocks)  # at least one of them is out of order


def test_order_and_nesting_of_classes():
    assert template.out_of_order([1, 9, 2, 3], [[1, 2, 3]]) == set()
    assert template.out_of_order([1, 3, 2, 4, 5], [[1, 2, 3, 4, 5]]) in ({2}, {3})
    assert template.out_of_order([1, 2, 1, 2], [[1, 2]]) == set() and template.out_of_order([1, 1, 2, 2], [[1, 2]]) != set()
    lies, crossing = template.enclosures([1, 4, 5, 2, 4, 5, 3], [[1, 2, 3], [4, 5]])
    assert crossing == set() and len([c for c, _ in lies if c == 1]) == 2  # in two gaps
    assert template.enclosures([1, 4, 2, 5, 3], [[1, 2, 3], [4, 5]])[1] == {1}
    assert template.enclosures([4, 1, 2, 3, 5], [[1, 2, 3], [4, 5]])[1] == set()
    assert template.enclosures([4, 1, 5, 2, 3], [[1, 2, 3], [4, 5]])[1] == {1}


def _shingles(text):
    words = text.encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_fingerprints_of_edits(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(f"u{i}", " ".join(words[i * 7 : i * 7 + n]), "s") for i, n in enumerate([400, 400, 3, 60, 1200, 0, 5, 900, 30, 30])]
    got = {r["URL"]: r for r in minhash.fingerprints_of_edits(articles(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for (u, t, _), (_, following, _) in zip(order, order[1:] + order[:1]):
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        assert got[u]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", following)):
            a, b = _shingles(t), _shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(got[u][name] - true) < 0.13, (u, name, true)
    assert got["u5"]["fingerprint"] == "0" * 512


def test_fingerprints_of_awkward_rows(spark):
    rows = collected(minhash.fingerprints_of_edits(articles(spark, AWKWARD)))
    assert len(rows) == len(AWKWARD)
    assert len({r["fingerprint"] for r in rows if r["n_chars"] == len(AWKWARD[0][1])}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == 512 for r in rows)
    (one,) = collected(minhash.fingerprints_of_edits(articles(spark, AWKWARD[:1])))
    assert one["near_next"] == 1.0
    assert minhash.fingerprints_of_edits(articles(spark, [])).count() == 0
    prints = {r["URL"]: r["fingerprint"] for r in minhash.fingerprints(articles(spark, AWKWARD)).collect()}
    assert prints["https://a.example/1"] == prints["https://a.example/2"] == prints["https://a.example/3"]
