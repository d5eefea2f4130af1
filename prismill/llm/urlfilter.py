"""Allow and block articles by URL rules and by the aliases that redirects and canonical links make."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismill.llm.common import narrow
from prismill.operators.clustering import connected_components
from prismill.session import cut_lineage


class Rule(NamedTuple):
    """``allow`` or ``block`` for a host with its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """The URL without its fragment, scheme and host in lower case: spellings of one request are one address."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    start = F.regexp_extract(plain, r"(?s)^.*?://[^/?]*", 0)
    return F.concat(F.translate(start, _UPPER, _LOWER), F.substr(plain, F.length(start) + 1))


def resolved(base: Column, link: Column) -> Column:
    """The address a link on a page leads to."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    site = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*(/[^?#]*/|/)?", 1)
    return address_of(
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def page_links(pages: DataFrame, url: str = "URL", html: str = "html") -> DataFrame:
    """Alias links (``a``, ``b``) that pages declare: canonical links and immediate refreshes, over the whole markup."""
    rows = narrow(pages, url=url, html=html).where("url is not null and html is not null")
    canonical = F.regexp_extract("html", r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b)[^>]*\bhref\s*=\s*["']?([^"'>\s]+)""", 1)
    refresh = F.regexp_extract("html", r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*\burl\s*=\s*["']?([^"'>\s]+)""", 1)
    return (
        rows.select("url", F.explode(F.array(canonical, refresh)).alias("link")).where("link <> ''")
        .select(address_of(F.col("url")).alias("a"), resolved(F.col("url"), F.col("link")).alias("b"))
    )


def matching(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does. The rules are a configured list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # a longer one is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def judge_urls(articles: DataFrame, rules: Sequence[Rule], links: DataFrame | None = None, key: str = "URL", url: str = "URL") -> DataFrame:
    """Whether each article's address is allowed or blocked, and by which rule.

    Works on the articles of the feeds (``URL``) or on any table with an id and a URL. The longest rule that fits decides.
    An address without a rule is blocked if redirects and canonical links (``links``: ``a``, ``b``) join it, over any
    number of steps, to an address that a rule blocks, else allowed; a rule that allows an address stands whatever its
    aliases are. Components are found by distributed label rounds over the links alone, and addresses are judged
    once however many articles have them.

    Returns one row per article: the key, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``. A null URL or one without
    ``://`` has an empty host and path, no rule, and is allowed; null links are ignored; repeated rows come back as
    often as they came. An empty table gives an empty result.
    """
    rows = narrow(articles, id=key, url=url).select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matching(rules, F.col("host"), F.col("path"))
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("own"), address_of(F.col("url")).alias("address"))
    out = [F.col("id").alias(key), "host", "path", "rule"]
    if links is None:
        return rows.select(*out, F.coalesce("own", F.lit("allow")).alias("verdict"))
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = cut_lineage(links.union(links.select("b", "a")).distinct())
    nodes = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("label"))
    groups = connected_components(nodes, both)
    _, named = matching(rules, host_of(F.col("node")), path_of(F.col("node")))
    groups = groups.withColumn("named", named)
    bad = groups.where("named = 'block'").select("label").distinct()
    aliases = groups.join(bad, "label", "left_semi").select(F.col("node").alias("address"), F.lit("block").alias("heard"))
    joined = rows.join(aliases, "address", "left")
    return joined.select(*out, F.coalesce("own", "heard", F.lit("allow")).alias("verdict"))
