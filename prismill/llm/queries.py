"""Thin queries that map the given tables to the operators and their results back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismill.llm import conversations, crossentropy, exact, minhash, mixing, packing, phrases, simhash, substring, template, tokencounts, toxicity, urlfilter
from prismill.llm.urlfilter import Rule
from prismill.plans.registry import query, table

ID = {"key": "doc_id", "text": "text"}
THRESHOLD = 0.7
RULES = [
    Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_simhash_near_copies", covers="")
def op1_simhash_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_copies(table(spark, sf_dir, "documents"), **ID)


@query("op2_source_mix", covers="")
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), **ID, source="source")


@query("op3_exact_copies", covers="", sql="""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body
        FROM documents
    ), r AS (
        SELECT doc_id, n_chars, sha256(body) AS text_sha256, count(*) OVER (PARTITION BY body) AS group_size,
            first_value(doc_id) OVER (PARTITION BY body ORDER BY n_chars DESC, doc_id) AS keep_id
        FROM d
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, n_chars FROM r
""")
def op3_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for every document's text."""
    return exact.exact_copies(table(spark, sf_dir, "documents"), **ID)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_model(spark: SparkSession, documents: DataFrame, sf_dir: str) -> toxicity.Field:
    """The field fitted to labelled rows that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    return toxicity.fit_field(documents, labels, "toxic", **ID)


@query("op5_toxicity", covers="")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from rows that are not held out."""
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(documents, toxicity_model(spark, documents, sf_dir), **ID, threshold=THRESHOLD)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "spans")


@query("op8_best_fit_packing", covers="")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return packing.pack_articles(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), **ID)


_HOST = r"lower(regexp_extract(coalesce({0}, ''), '^.*?://([^/?#]*)', 1, 's'))"
_PATH = r"regexp_extract(coalesce({0}, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r.name))
_FITS = "CASE " + " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.verdict} {r.name}'" for r in _BY_LENGTH
) + " END"


@query("op4_url_filter", covers="", sql=rf"""
    WITH RECURSIVE p AS (
        SELECT page_id, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path, regexp_replace(url, '#.*$', '', 's') AS address, html FROM pages
    ), l AS (
        SELECT address AS a, regexp_replace(replace(t, '&amp;', '&'), '#.*$', '', 's') AS b FROM (
            SELECT address, regexp_extract(html, '<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1, 'is') AS t FROM p
            UNION ALL SELECT address, regexp_extract(html, '<meta[^>]*http-equiv="refresh"[^>]*url=([^">\s]+)', 1, 'is') FROM p
        ) WHERE t LIKE '%://%' AND address IS NOT NULL
    ), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    seed AS (SELECT a AS address FROM (SELECT a, {_HOST.format("a")} AS host, {_PATH.format("a")} AS path FROM e) WHERE ({_FITS}) LIKE 'block %'),
    bad AS (SELECT address FROM seed UNION SELECT e.b FROM bad JOIN e ON e.a = bad.address),
    j AS (SELECT page_id, host, path, address, {_FITS} AS fit FROM p)
    SELECT page_id, host, path, CASE WHEN fit IS NOT NULL THEN substr(fit, strpos(fit, ' ') + 1) END AS rule,
        CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 1) WHEN address IN (SELECT address FROM bad) THEN 'block' ELSE 'allow' END AS verdict
    FROM j
""")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's address."""
    pages = table(spark, sf_dir, "pages")
    links = urlfilter.page_links(pages, url="url", html="html")
    return urlfilter.judge_urls(pages, RULES, links, key="page_id", url="url")


@query("op6_cross_entropy_difference", covers="")
def op6_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss per word under the model of good documents less that under the model of all."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return crossentropy.cross_entropy_difference(table(spark, sf_dir, "documents"), good, **ID)


@query("op7_token_counts", covers="")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), **ID)


@query("op9_page_text", covers="")
def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return template.extract_articles(table(spark, sf_dir, "pages"), key="page_id", url="url", markup="html")


@query("op10_minhash_fingerprints", covers="")
def op10_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return minhash.fingerprints_of_edits(table(spark, sf_dir, "documents"), **ID)


@query("op13_substring_repeats", covers="")
def op13_substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those in windows of 35 that repeat, and the digest of what stays."""
    kept = substring.without_repeats(table(spark, sf_dir, "documents"), **ID)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("op12_phrase_collocations", covers="", sql=rf"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_LETTERS}) AS t FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) AS piece FROM d),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM p),
    g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: w[i : i + size - 1])) AS words FROM w, (VALUES (1), (2), (3), (4)) AS s(size)),
    f AS (SELECT lang, words, size, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
    c AS (SELECT lang, words, size, f AS a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
    s AS (
        SELECT c.lang, c.words, c.size, a, k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
        FROM c JOIN f x ON x.lang = c.lang AND x.words = c.words[1 : k] JOIN f y ON y.lang = c.lang AND y.words = c.words[k + 1 : c.size]
    ), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
    i AS (SELECT lang, f AS a, words, size, unnest(range(2, size)) AS part FROM f WHERE size > 2),
    j AS (SELECT lang, a, unnest(list_transform(range(1, size - part + 2), lambda q: words[q : q + part - 1])) AS words FROM i),
    m AS (SELECT lang, words, max(a) AS longer FROM j GROUP BY ALL),
    r AS (SELECT b.*, array_to_string(b.words, ' ') AS phrase FROM b LEFT JOIN m ON m.lang = b.lang AND m.words = b.words WHERE longer IS NULL OR 100 * longer < 80 * b.a)
    SELECT r.lang, row_number() OVER (PARTITION BY r.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r.r AS r, n, score
    FROM r JOIN n ON n.lang = r.lang QUALIFY rank <= 2000
""")
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    found = phrases.collocations(table(spark, sf_dir, "documents"), text="text", language="lang")
    return found.withColumnRenamed("language", "lang")


def damaged(messages: DataFrame) -> DataFrame:
    """Messages lost, emptied, cut, repeated or misnamed by the checksum of conversation and turn."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")) % 20
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), harm.alias("harm"))
    rows = rows.where("harm <> 0").withColumns({
        "text": F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("harm") == 4, "user").otherwise(F.col("role")),
        "time": F.explode(F.array_repeat(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1))),
    })
    return rows.select("conv_id", "turn", "role", "text")


@query("op11_conversation_repair", covers="")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    given = table(spark, sf_dir, "conversations")
    messages = damaged(given)
    summary, edits = conversations.find_edits(messages)
    hashes = conversations.digests(conversations.repaired_messages(messages, edits)).withColumnRenamed("conv", "_conv")
    every = given.select("conv_id").distinct()
    found = every.join(summary, every["conv_id"].eqNullSafe(summary["conv"]), "left")
    found = found.join(hashes, found["conv_id"].eqNullSafe(hashes["_conv"]), "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
