"""Similar texts against brute-force Jaccard likeness."""

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from prismill.llm import simhash, similar
from prismill.session import cut_lineage

from .articles import AWKWARD, articles, collected

FOLDER = "/root/testdata/sf0.01"


def by_hand(texts):
    """Groups of texts linked at four fifths, as a label per text."""
    sets = [similar.shingles((t or "").encode()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_groups_equal_brute_force(spark):
    """Edited copies, chains of edits, and a passage many texts share without being alike."""
    luck = random.Random(5)
    words = lambda n: [f"w{luck.randrange(5000)}" for _ in range(n)]
    common, texts = words(60), []
    for _ in range(12):
        text = words(150)
        for _ in range(8):
            texts.append(" ".join(text))
            for _ in range(luck.choice([1, 2, 3, 4])):
                text[luck.randrange(len(text))] = f"e{luck.randrange(5000)}"
    texts += [" ".join(common + words(40)) for _ in range(40)]
    luck.shuffle(texts)
    rows = articles(spark, [(f"u{i:04d}", t, "s") for i, t in enumerate(texts)])
    label = by_hand(texts)
    assert 52 < len(set(label)) < len(texts)
    assert sorted(r["URL"] for r in collected(similar.without_similar(rows))) == sorted({f"u{x:04d}" for x in label})


def test_texts_with_and_without_keys(spark):
    rows = AWKWARD + [("https://a.example/9", "another text under the same key as one before", "beta")]
    out = collected(similar.without_similar(articles(spark, rows)))
    assert len({by for by in by_hand([t for _, t, _ in rows])}) == len(out)
    assert {r["要約"] for r in out} >= {"another text under the same key as one before", "Nobody knows where this one came from."}
    assert collected(similar.without_similar(articles(spark, []))) == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline_stage_leaves_no_pair_at_four_fifths(spark):
    docs = cut_lineage(corpus_pipeline.drop_exact_copies(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER))
    given = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    label = by_hand([t for _, t in given])
    assert len(set(label)) < len(given)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()) == sorted(given[x][0] for x in set(label))


def test_prefixes_lose_no_pair():
    """Texts at four fifths and a little more share a shingle among the first of any common order, and stay within the radius."""
    luck = random.Random(8)
    furthest = 0
    for _ in range(300):
        n = luck.randrange(5, 400)
        text = [f"w{luck.randrange(300)}" for _ in range(n)]
        other = list(text)
        sets = None
        while True:
            other[luck.randrange(n)] = f"e{luck.randrange(300)}"
            x, y = similar.hashes(" ".join(text).encode()), similar.hashes(" ".join(other).encode())
            both = len(set(x) & set(y))
            if both < 0.8 * (len(x) + len(y) - both):
                break
            sets = (x, y)
        if sets:
            firsts = [set(own[: len(own) - -(-len(own) * 4 // 5) + 1].tolist()) for own in sets]
            assert firsts[0] & firsts[1]
            prints = [similar.fingerprint(own) & (1 << 64) - 1 for own in sets]
            furthest = max(furthest, (prints[0] ^ prints[1]).bit_count())
    assert furthest <= similar.RADIUS - 6


def test_extra_columns_keep_their_values(spark):
    rows = spark.createDataFrame([(f"u{i}", "t " * i, "mine", 5, "d") for i in range(3)], "URL string, `要約` string, own string, id int, digest string")
    out = similar.without_similar(rows)
    assert out.columns == ["URL", "要約", "own", "id", "digest"] and {(r["own"], r["id"], r["digest"]) for r in out.collect()} == {("mine", 5, "d")}


def test_a_large_group_has_few_partners_a_text(spark):
    """Each place drew its own text before: about as many pairs as places."""
    places = spark.range(200).crossJoin(spark.range(40).withColumnRenamed("id", "place"))
    placed = places.select(
        F.xxhash64("place").alias("key"), F.col("id").alias("doc"), F.col("id").alias("label"), F.lit(100).alias("size"),
        F.lit(7).alias("print"), F.col("place"), F.lit(200).alias("n"),
    )
    pairs = similar._star(placed, 0, 0.8)
    assert 199 <= pairs.count() <= 199 * similar.HEADS
    ends = pairs.select("a").union(pairs.select("b")).distinct().count()
    assert ends == 200


def test_pipeline_stage_asks_the_fingerprints(spark, monkeypatch):
    """Near copies by fingerprint are held against each other first; the texts decide, so a wrong one changes nothing."""
    luck, given, asked = random.Random(3), [], []
    words = lambda n: [f"w{luck.randrange(5000)}" for _ in range(n)]
    base = words(400)
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base[1:]), " ".join(words(300)), None, "", " ".join(base) + " "]
    rows = [(i if i != 6 else None, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near, alike = simhash.near_copies, similar._alike_pairs
    monkeypatch.setattr(simhash, "near_copies", lambda rows, *a, **k: given.append(rows.count()) or near(rows, *a, **k))
    monkeypatch.setattr(similar, "_alike_pairs", lambda pairs, *rest: asked.append(pairs.count()) or alike(pairs, *rest))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert len(set(by_hand([(t or "").strip() for t in texts]))) == 3 and kept == {0, 3, 4}
    assert given == [7] and asked[0] == 3  # the other versions of the first text, before any shingle is looked at
    monkeypatch.setattr(simhash, "near_copies", lambda rows, *a, **k: near(rows, *a, **k).withColumn("component_id", F.first("digest").over(Window.orderBy("digest").rowsBetween(Window.unboundedPreceding, 0))))
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {0, 3, 4}
