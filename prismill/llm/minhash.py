"""One-permutation MinHash fingerprints of articles, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismill.llm.common import BLANK, filled, narrow, numbered
from prismill.session import cut_lineage

BINS = 256  # a bin is the top byte of a hash
_LOW = (1 << 56) - 1
_TRIES = 4  # bins an empty one asks in turn before it asks all
_PER_LONG = 8  # low bytes a long holds


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _empty(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_LOW)) == F.lit(_LOW)


def with_sketch(rows: DataFrame, text: str, out: str, width: int = 5) -> DataFrame:
    """Add ``out``: the low bytes of the least word-shingle hash of each of 256 bins, eight to a long.

    Every shingle is hashed once. A mark at the top of each bin is sorted in with the hashes, so the first
    value of a bin is its least hash, or the mark where it is empty. Empty bins are filled by optimal
    densification: each asks bins in an order of its own, the same in every text, and copies the first that
    is filled.
    """
    keep = [c for c in rows.columns if c != out]
    words = F.split(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), f"[{BLANK}]+")
    marks = F.array(*[F.lit(_signed((j << 56) | _LOW)) for j in range(BINS)])
    top = lambda v: F.shiftright(v, 56)
    step = rows.select(*keep, words.alias("_w"))
    many = F.transform(
        F.sequence(F.lit(0), F.size("_w") - F.lit(width)),
        lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(width)]),
    )
    few = F.when(F.element_at("_w", 1) == "", F.array().cast("array<long>")).otherwise(F.array(F.xxhash64("_w")))
    step = step.select(*keep, F.when(F.size("_w") >= width, many).otherwise(few).alias("_h"))
    step = step.select(*keep, (F.size("_h") > 0).alias("_any"), F.sort_array(F.concat("_h", marks)).alias("_s"))
    step = step.select(
        *keep, "_any", F.filter("_s", lambda v, i: (i == 0) | (top(v) != top(F.get(F.col("_s"), i - 1)))).alias("_f")
    )
    asked = F.aggregate(
        F.array(*[F.lit(t) for t in range(_TRIES)]), F.col("_f"),
        lambda now, t: F.when(F.exists(now, _empty), F.transform(
            now, lambda v, j: F.when(_empty(v), F.get(F.col("_f"), F.pmod(F.xxhash64(j, t), F.lit(BINS)).cast("int"))).otherwise(v)
        )).otherwise(now),
    )
    step = step.select(*keep, "_any", "_f", F.when(F.exists("_f", _empty) & F.col("_any"), asked).otherwise(F.col("_f")).alias("_d"))
    # all filled bins, for those that are still empty
    full = F.when(F.exists("_d", _empty) & F.col("_any"), F.filter("_f", lambda v: ~_empty(v))).otherwise(F.array().cast("array<long>"))
    step = step.select(*keep, "_any", "_d", full.alias("_o"))
    least = lambda j: F.array_min(F.transform(F.col("_o"), lambda v: F.struct(F.xxhash64(j, top(v)).alias("a"), v.alias("b")))).getField("b")
    dense = F.when(F.size("_o") > 0, F.transform("_d", lambda v, j: F.when(_empty(v), least(j)).otherwise(v))).otherwise(F.col("_d"))
    step = step.select(*keep, "_any", dense.alias("_d"))

    def packed(k: Column) -> Column:
        one = F.lit(0).cast("long")
        for b in range(_PER_LONG):
            one = one.bitwiseOR(F.shiftleft(F.get(F.col("_d"), k * _PER_LONG + b).bitwiseAND(F.lit(255)), 8 * b))
        return one

    longs = BINS // _PER_LONG
    sketch = F.when(F.col("_any"), F.transform(F.sequence(F.lit(0), F.lit(longs - 1)), packed))
    return step.select(*keep, sketch.otherwise(F.array_repeat(F.lit(0).cast("long"), longs)).alias(out))


def likeness(left: Column, right: Column) -> Column:
    """Estimated share of common shingles of two sketches: equal bytes, less those equal by chance, 0 to 1."""

    def differing(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        return F.bit_count(x)

    unequal = F.aggregate(F.zip_with(left, right, differing), F.lit(0), lambda s, d: s + d)
    chance = 1 / 256
    return F.greatest(F.lit(0.0), (1 - unequal / F.lit(float(BINS)) - chance) / F.lit(1 - chance))


def sketch_text(sketch: Column) -> Column:
    """A sketch as hexadecimal digits."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprints(articles: DataFrame, key: str = "URL", text: str = "要約") -> DataFrame:
    """Fingerprint of every article's whole text: the key and ``fingerprint``.

    Null and empty texts, and texts of white space, have a fingerprint of zeros; texts of fewer than five words are one
    shingle; equal texts have equal fingerprints.
    """
    rows = narrow(articles, id=key, text=text).select("id", filled("text").alias("text"))
    return with_sketch(rows, "text", "sketch").select(F.col("id").alias(key), sketch_text(F.col("sketch")).alias("fingerprint"))


def fingerprints_of_edits(articles: DataFrame, key: str = "URL", text: str = "要約") -> DataFrame:
    """Fingerprints of articles and of edited texts, and how alike they are.

    Works on the articles of the feeds (``URL``, ``要約``) or on any table with an id and a text. The edited text has its last
    third of code points (rounded down) replaced by the first as many, or all, of the next article's, in descending order of
    the key; the first follows the last. The order is found on keys, lengths and sketches; then each text moves once, and
    the start of it that the article before needs once more.

    Returns one row per article: the key, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next`` (estimated likeness to the edited text and to the next article's, 0 to 1). A null text is empty; null
    keys come last; articles with one key follow each other by a hash of the text; repeated rows stand once in the order
    and all get the same result; a single article is its own next. An empty table gives an empty result.
    """
    rows = narrow(articles, id=key, text=text)
    whole = filled("text")
    # 128 bits of a SHA-256: two of 5e10 articles share a name with a chance of 4e-18
    row = F.concat(F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")), F.lit("\n"), whole)
    name = F.unhex(F.substring(F.sha2(row.cast("binary"), 256), 1, 32))
    named = rows.select("id", whole.alias("text"), name.alias("name"))
    known = cut_lineage(with_sketch(named.withColumn("n", F.length("text").cast("long")), "text", "sketch").drop("text"))
    # the order needs neither texts nor sketches
    placed = cut_lineage(numbered(known.select("id", "name", "n").distinct(), F.col("id").desc_nulls_last(), F.col("name")))
    n = placed.count()
    after = placed.select(F.col("name").alias("donor"), F.pmod(F.col("position") - 1, F.lit(max(n, 1))).alias("position"))
    pairs = placed.join(after, "position").select("id", F.col("name").alias("to"), "n", "donor", F.floor(F.col("n") / 3).alias("need"))

    # texts and sketches are dealt by name once, for giving and for taking
    texts, sketches = named.select("name", "text"), known.select("name", "sketch")
    repeated = known.count() > n
    if repeated:  # rows of one name are alike
        sketches = sketches.dropDuplicates(["name"])
    giving = texts.join(pairs, texts["name"] == pairs["donor"]).join(sketches, "name").select(
        "id", "to", "n", F.expr("substring(text, 1, cast(need as int))").alias("start"), F.col("sketch").alias("donor_sketch")
    )
    if repeated:
        giving = giving.dropDuplicates(["to"])
    taking = texts.join(giving, texts["name"] == giving["to"]).join(sketches, "name").select(
        "id", "n", "sketch", "donor_sketch", F.expr("concat(substring(text, 1, cast(n - floor(n / 3) as int)), start)").alias("edited")
    )
    edited = with_sketch(taking, "edited", "edited_sketch")
    return edited.select(
        F.col("id").alias(key), F.col("n").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch_text(F.col("sketch")).alias("fingerprint"), sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("donor_sketch")).alias("near_next"),
    )
