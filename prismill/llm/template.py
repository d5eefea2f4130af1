"""Main text of article pages by templates deduced from pages of the same host."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismill.llm.common import filled, narrow, stored
from prismill.llm.urlfilter import host_of
from prismill.session import cut_lineage

LEAST_PAGES = 3  # different pages of a host that show a template
LEAST_TOKENS = 2  # tokens of a class of the template
SENT = 1 << 21  # tokens of templates that are sent to all pages, rather than pages to templates
_SAID = 1 << 16  # findings about pages that are held at once

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Za-z]+")

# Element names of HTML.
_RAW = frozenset("script style noscript textarea title template iframe svg math object select canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: what an open element of these is closed by
_CLOSES = {
    "p": _BLOCK - {"body", "html", "head"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "head": frozenset({"body"}),
}
_MAIN = frozenset("article main".split())
_OUTSIDE = frozenset("nav header footer aside form menu dialog button label search head".split())
#: words of class, id or role that name a part beside the article
_BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners promo promotion sponsor sponsored nav navbar navigation menu menus "
    "sidebar aside footer header masthead topbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist "
    "disqus respond replies reply widget widgets toolbar search pagination pager copyright legal skip".split()
)
#: elements that part blocks; the stack starts with the nameless page
_PARTS = _BLOCK | _OUTSIDE | {""}
_BODY_ROLE = frozenset("main article".split())


class Block(NamedTuple):
    """A run of text between block tags."""

    text: str
    main: bool  # inside the article element
    beside: bool  # inside a menu, header, form, advert and the like
    heading: bool
    slot: int  # number of the tag token before it
    linked: int  # characters inside links


class Page(NamedTuple):
    tokens: list[int]  # hashes of the tags with their place in the nesting, in page order
    blocks: list[Block]


def _hash(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def read_page(page: str) -> Page:
    """Tag tokens and text blocks of a page in one pass over its markup."""
    tokens: list[int] = []
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # element, inside the article, beside it
    path = [""]
    parts: list[str] = []
    linked, links, heading, at = 0, 0, False, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, stack[-1][1], stack[-1][2], heading, len(tokens) - 1, linked))
            parts = []
        linked = 0

    while m := _TOKEN.match(page, at):
        at = m.end()
        name = m.group(2)
        if name is None:
            if not m.group().startswith(("<!", "<?")) and stack[-1][0] in _PARTS:
                text = html.unescape(m.group())
                parts.append(text)
                if links:
                    linked += len(text.strip())
            continue
        name = name.lower()
        closing = m.group(1) == "/"
        if name in _RAW:
            if not closing and not m.group(3).endswith("/"):  # what is inside is no markup
                end = re.compile(f"</{name}(?![A-Za-z0-9:-])", re.I).search(page, at)
                at = end.start() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
        found: dict[str, str] = {}
        words: set[str] = set()
        if not closing and m.group(3).strip(" /"):
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m.group(3))}
            words = set(_NAME.findall(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower()))
        apart = bool(words & _BESIDE) or "hidden" in found or found.get("aria-hidden") == "true"
        if name not in _PARTS:
            # an inline element counts only if it names itself as a part beside the article
            if apart and name not in _VOID:
                stack.append((name, stack[-1][1], True))
                path.append(path[-1])
            elif closing and stack[-1][0] == name:
                stack.pop()
                path.pop()
            continue
        flush()
        if name in _HEADINGS:
            heading = not closing
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:], path[i:]
                    break
            continue
        while len(stack) > 1 and name in _CLOSES.get(stack[-1][0], ()):
            stack.pop()
            path.pop()
        _, main, beside = stack[-1]
        beside = beside or apart
        main = main or found.get("role", "") in _BODY_ROLE
        label = ".".join([name, *sorted(words)])
        if name in _MAIN:
            main, beside = True, beside and stack[-1][1]
        elif name in _OUTSIDE and not (name == "header" and main):  # an article's own header has its title
            beside = True
        tokens.append(_hash(f"{path[-1]}<{label}"))
        if name not in _VOID:
            stack.append((name, main, beside))
            path.append(f"{path[-1]}/{label}")
    flush()
    return Page(tokens, blocks)


def sequence(read: Page) -> list[tuple[int, int]]:
    """The page's tokens in page order, tags and texts, and for texts the number of their block (-1 for tags)."""
    out: list[tuple[int, int]] = []
    block = 0
    for slot in range(-1, len(read.tokens)):
        if slot >= 0:
            out.append((read.tokens[slot], -1))
        while block < len(read.blocks) and read.blocks[block].slot == slot:
            out.append((_hash("=" + read.blocks[block].text), block))
            block += 1
    return out


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its tokens in order, and the text and linked text that follow each tag."""
    for batch in batches:
        tokens, chars, links = [], [], []
        for page in batch.column(2):
            read = read_page(page.as_py())
            order = sequence(read)
            size, linked, tag = [0] * len(order), [0] * len(order), -1
            for i, (_, block) in enumerate(order):
                if block < 0:
                    tag = i
                elif tag >= 0:
                    size[tag] += len(read.blocks[block].text)
                    linked[tag] += read.blocks[block].linked
            tokens.append([t for t, _ in order])
            chars.append(size)
            links.append(linked)
        columns = [pa.array(x, pa.list_(pa.int64())) for x in (tokens, chars, links)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["host", "digest", "tokens", "chars", "links"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and token: how often it occurs, where first, and the text and linked text that follow it."""
    for batch in batches:
        rows, found = [], []
        for row, sizes in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tokens", "chars", "links")))):
            seen: dict[int, list[int]] = {}
            for i, (t, c, k) in enumerate(zip(*sizes)):
                own = seen.setdefault(t, [0, i, 0, 0])
                own[0] += 1
                own[2] += c
                own[3] += k
            rows += [row] * len(seen)
            found += [(t, *own) for t, own in seen.items()]
        at = pa.array(rows, pa.int64())
        numbers = [pa.array([f[i] for f in found], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("host").take(at), batch.column("digest").take(at), *numbers], names=["host", "digest", "token", "times", "first", "chars", "links"]
        )


def out_of_order(tokens: list[int], classes: list[list[int]]) -> set[int]:
    """Tokens of the classes that do not follow the order of their class on this page.

    A class's tokens must come round after round, each in its order. What is not in the longest such run is out of order.
    """
    place = {t: (c, i) for c, own in enumerate(classes) for i, t in enumerate(own)}
    seen: dict[int, int] = {}
    keys: list[list[tuple[int, int]]] = [[] for _ in classes]
    for t in tokens:
        if t in place:
            c, i = place[t]
            keys[c].append((seen.get(t, 0) * len(classes[c]) + i, t))
            seen[t] = seen.get(t, 0) + 1
    out: set[int] = set()
    for own in keys:
        ends: list[int] = []  # places in ``own`` that end the runs of each length, least keys first
        before = [-1] * len(own)
        for at, (key, _) in enumerate(own):
            k = bisect_left(ends, key, key=lambda e: own[e][0])
            before[at] = ends[k - 1] if k else -1
            ends[k : k + 1] = [at]
        at, kept = ends[-1] if ends else -1, set()
        while at >= 0:
            kept.add(at)
            at = before[at]
        out |= {t for at, (_, t) in enumerate(own) if at not in kept}
    return out


def enclosures(tokens: list[int], classes: list[list[int]]) -> tuple[set[tuple[int, int]], set[int]]:
    """What the nesting of ordered classes, strongest first, is on this page: (class, hash of the gap it lies in), and classes that cross others.

    A class's round is open from its first token to its last. Others must lie in one gap between two of its tokens; of two that cross, the weaker does not fit.
    """
    place = {t: (c, i) for c, own in enumerate(classes) for i, t in enumerate(own)}
    lies: set[tuple[int, int]] = set()
    crossing: set[int] = set()
    open_: list[tuple[int, int]] = []  # class and the place of its last token
    for t in tokens:
        if t not in place:
            continue
        c, i = place[t]
        if i == 0:
            around = [f"{o}.{at}" for o, at in open_ if o < c]
            lies.add((c, _hash("/".join(around))))
        else:
            at = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == c), None)
            if at is None:
                continue  # dropped before by a stronger one
            above = [o for o, _ in open_[at + 1 :]]
            del open_[at]
            if above and min(above) < c:
                crossing.add(c)
                continue
            crossing.update(above)
            del open_[at:]
        if i + 1 < len(classes[c]):
            open_.append((c, i))
    crossing.update(o for o, _ in open_)
    return lies, crossing


def _checked(read: DataFrame, classes: DataFrame, found: Callable[[list[int], list[list[int]]], list[tuple[int, int]]]) -> DataFrame:
    """What ``found`` says of pages and the classes of their host: ``host``, ``a`` and ``b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[tuple] = set()
        for batch in batches:
            for host, tokens, own in zip(*(batch.column(c).to_pylist() for c in ("host", "tokens", "classes"))):
                said.update((host, a, b) for a, b in found(tokens, own))
            if len(said) > _SAID:
                yield pa.RecordBatch.from_pylist([dict(zip(("host", "a", "b"), r)) for r in said], schema=schema)
                said = set()
        yield pa.RecordBatch.from_pylist([dict(zip(("host", "a", "b"), r)) for r in said], schema=schema)

    schema = pa.schema([("host", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
    per_host = classes.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("strength", "tokens"))), lambda c: c["tokens"]).alias("classes"))
    rows = to_pages(read.select("host", "tokens"), per_host, "classes", "inner")
    return rows.select("host", "tokens", "classes").mapInArrow(run, "host string, a long, b long").distinct()


def to_pages(pages: DataFrame, per_host: DataFrame, names: str, how: str) -> DataFrame:
    """Pages with what their host says. It is sent to the pages while it is small, so that pages of one host need not meet."""
    per_host = cut_lineage(per_host)
    size = per_host.agg(F.sum(F.size(names))).first()[0] or 0
    return pages.join(F.broadcast(per_host) if size <= SENT else per_host, "host", how)


def host_templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Template of each host with enough pages: ``fixed`` (tokens of its classes) and ``menus`` (tokens that are followed by links).

    ``pages`` has host and html; copies of a page are one page. Tokens (tags with their nesting, and texts, those of the article too)
    with the same occurrence vector over the host's pages are one equivalence class; the vector is known by the XOR of hashes of (page, times), so
    classes come from sums that merge in every task, whatever a host holds. A class can be part of the template if it
    spans half of the host's pages; the number of its tokens is at most twice a page's mean number of tokens.
    Of these, tokens that leave the order of their class on some page are dropped (:func:`out_of_order`), then classes of fewer than
    ``LEAST_TOKENS``, then those that cross a stronger class or do not always lie in the same gap of the stronger ones (:func:`enclosures`).
    """
    given = pages.select("host", F.unhex(F.md5(F.col("html").cast("binary"))).alias("digest"), "html")
    read = given.mapInArrow(_sequences, "host string, digest binary, tokens array<long>, chars array<long>, links array<long>")
    read = stored(read.dropDuplicates(["host", "digest"]))
    seen = read.mapInArrow(_occurrences, "host string, digest binary, token long, times long, first long, chars long, links long")
    per_token = seen.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("digest", "times")).alias("vector"), F.sum("first").alias("first"),
        F.sum("chars").alias("chars"), F.sum("links").alias("links"),
    )
    hosts = read.groupBy("host").agg(F.count("*").alias("host_pages"))
    often = per_token.join(hosts, "host").where((F.col("host_pages") >= least_pages) & (2 * F.col("pages") >= F.col("host_pages")))
    often = stored(often.select("host", "token", "pages", "vector", "first", (2 * F.col("links") > F.col("chars")).alias("menu")))

    unordered = _checked(read, _classes(often), lambda tokens, classes: [(t, 0) for t in out_of_order(tokens, classes)])
    ordered = stored(_classes(often.join(unordered.select("host", F.col("a").alias("token")), ["host", "token"], "left_anti")))

    def nesting(tokens: list[int], classes: list[list[int]]) -> list[tuple[int, int]]:
        lies, crossing = enclosures(tokens, classes)
        return [*((c, gap) for c, gap in lies), *((c, side) for c in crossing for side in (0, 1))]  # two places: in no gap

    places = _checked(read, ordered, nesting).groupBy("host", F.col("a").alias("place")).agg(F.count("*").alias("n")).where("n > 1")
    wrong = places.groupBy("host").agg(F.collect_list("place").alias("wrong"))
    numbered = ordered.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("strength", "tokens"))), lambda c: c["tokens"]).alias("classes"))
    valid = F.filter("classes", lambda c, i: ~F.array_contains(F.coalesce("wrong", F.array().cast("array<long>")), i.cast("long")))
    fixed = numbered.join(wrong, "host", "left").select("host", F.flatten(valid).alias("fixed"))
    menus = often.groupBy("host").agg(F.collect_list(F.when(F.col("menu"), F.col("token"))).alias("menus"))
    return menus.join(fixed, "host", "left").select("host", F.coalesce("fixed", F.array().cast("array<long>")).alias("fixed"), "menus")


def _classes(often: DataFrame) -> DataFrame:
    """Classes of enough tokens, these in the order of their mean place: ``strength`` (least: most pages, then most tokens) and ``tokens``."""
    tokens = F.transform(F.sort_array(F.collect_list(F.struct("first", "token"))), lambda t: t["token"])
    classes = often.groupBy("host", "vector", "pages").agg(tokens.alias("tokens")).where(F.size("tokens") >= LEAST_TOKENS)
    return classes.select("host", F.struct((-F.col("pages")).alias("pages"), (-F.size("tokens")).alias("size"), "vector").alias("strength"), "tokens")


def main_text(read: Page, fixed: set[int], menus: set[int]) -> str:
    """The blocks in the template's open slots, what is fixed left out: of the article if the page has one, else those that are no menu."""
    inside = [b for b in read.blocks if b.main and not b.beside]
    if not inside:
        inside = [b for b in read.blocks if not b.beside and not (b.slot >= 0 and read.tokens[b.slot] in menus) and 2 * b.linked <= len(b.text)]
    inside = [b for b in inside if _hash("=" + b.text) not in fixed]
    return "\n\n".join(b.text for b in inside)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            main_text(read_page(page.as_py()), set(fixed.as_py() or ()), set(menus.as_py() or ()))
            for page, fixed, menus in zip(batch.column(2), batch.column(3), batch.column(4))
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def extract_articles(pages: DataFrame, key: str = "URL", url: str = "URL", markup: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """The article of each page as plain text.

    Works on pages of the articles of the feeds (``URL`` and their ``html``) or on any table with an id, a URL and markup. Pages of one
    host share a template: tokens whose occurrence vectors over the host's pages are equal form classes, and classes
    that span half of the pages, nested by their place in the markup, are the template. Of its slots those of
    the article element are extracted; without one, those that are neither fixed text nor menus. Parts that name
    themselves as menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments never are. A host
    with fewer than ``least_pages`` pages has no template and goes by names alone.

    Returns one row per page: the key, the URL, ``text`` and ``n_chars``. Character references are decoded, white space in a block is one
    space, blocks are joined by two line breaks. Null or empty markup has an empty text; a null URL belongs to the host
    without a name; repeated rows come back as often as they came. An empty table gives an empty result.
    """
    names = {"id": key, "url": url, "html": markup}
    rows = narrow(pages, **names).select("id", "url", filled("html").alias("html"), host_of(F.col("url")).alias("host"))
    templates = host_templates(rows.select("host", "html"), least_pages).withColumn("both", F.concat("fixed", "menus"))
    kind = rows.schema["id"].dataType.simpleString()
    joined = to_pages(rows, templates, "both", "left").select("id", "url", "html", "fixed", "menus")
    done = joined.mapInArrow(_extract, f"id {kind}, url string, text string")
    out = [F.col("id").alias(key)] + ([F.col("url").alias(url)] if url != key else [])
    return done.select(*out, "text", F.length("text").cast("long").alias("n_chars"))
