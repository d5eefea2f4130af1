"""Toxicity, cross-entropy difference and token counts."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prismill.llm import crossentropy, tokencounts, toxicity
from tests.llm.articles import AWKWARD, articles, collected

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_chain_equals_word_by_word_forward_backward():
    model = toxicity.Field(words={"bad": 3.0, "awful": 2.0}, weights=np.array([-2.0, 1.5, 0.3, 0.2]), transitions=np.array([[0.4, -0.3], [-0.2, 0.5]]))
    words = "a bad b c d awful bad e f g h i j bad".split()
    gate = {w[:4] for w in model.words}
    places, values = toxicity.events(words, model, gate)
    got = toxicity.Chain(model.weights, model.transitions).run(places, values, len(words))
    own = np.ones((len(words), 2))
    own[:, 1] = math.exp(model.weights[0])
    for p, v in zip(places, values):
        own[p, 1] = math.exp(v @ model.weights)
    move = np.exp(model.transitions)
    f = [np.array([0.5, 0.5]) @ move * own[0]]
    for o in own[1:]:
        f.append(f[-1] @ move * o)
    b = [np.ones(2)]
    for o in own[:0:-1]:
        b.insert(0, move @ (o * b[0]))
    exact = [(x * y)[1] / (x * y).sum() for x, y in zip(f, b)]
    assert got == pytest.approx([exact[p] for p in places])


def _labelled(n=300):
    rng = random.Random(5)
    plain = [f"wo{i}rd" for i in range(200)]
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        label = int(i % 4 == 0)
        if label:
            for _ in range(3):
                words[rng.randrange(len(words))] = "vile" + rng.choice(["on", "en", "isch", "ung", "ant"]) if i % 8 else rng.choice(["vilain", "rotter"])
        out.append((f"u{i}", " ".join(words), label))
    return out


def test_field_finds_toxic_words_it_has_not_seen(spark):
    rows = _labelled()
    df = spark.createDataFrame(rows, "URL string, `要約` string, toxic int")
    model = toxicity.fit_field(df, df.where("hash(URL) % 3 <> 1"), least=3)
    scored = {r["URL"]: r for r in toxicity.score_toxicity(df, model).collect()}
    assert all((scored[u]["predicted"] == 1) == bool(y) for u, _, y in rows)
    text = "wo1rd vileheit wo2rd wo3rd vileung wo4rd"  # a new word with a known start
    (one,) = toxicity.score_toxicity(spark.createDataFrame([("x", text)], "URL string, `要約` string"), model).collect()
    assert one["predicted"] == 1
    marked = {text[s["start"] : s["end"]] for s in one["spans"]}
    assert marked and marked <= {"vileheit", "vileung"}
    kept = toxicity.without_toxic(df, model)
    assert {r["URL"] for r in kept.collect()} == {u for u, _, y in rows if not y}


def test_toxicity_of_awkward_rows(spark):
    for model in (toxicity.Field(), toxicity.fit_field(articles(spark, AWKWARD), articles(spark, []).selectExpr("*", "1 AS toxic"))):
        rows = collected(toxicity.score_toxicity(articles(spark, AWKWARD), model))
        assert len(rows) == len(AWKWARD)
        assert all(0 <= r["score"] < 0.5 and r["predicted"] == 0 and r["spans"] == [] for r in rows)
        assert toxicity.score_toxicity(articles(spark, []), model).count() == 0
        assert toxicity.without_toxic(articles(spark, AWKWARD), model).count() == len(AWKWARD)


def test_losses_are_of_a_distribution():
    """Over all words there are, and as many unseen ones as the vocabulary makes room for."""
    rng = np.random.default_rng(1)
    known = rng.choice(1 << 40, 3000, replace=False)
    text = rng.choice(known[:2000], 20_000)
    words, counts = np.unique(text, return_counts=True)
    model = crossentropy.Model(np.bincount(crossentropy.class_pairs(text)[2], minlength=crossentropy.CLASSES**2), 3000)
    history, total = int(text[17]), 0.0
    sizes = np.zeros(crossentropy.CLASSES)
    for word, n in zip(words, counts):
        sizes[word & (crossentropy.CLASSES - 1)] += 1
        total += math.exp(-model.losses(np.array([history, word]), np.array([0, n]), False)[1])
    unseen = 0.0
    for cls in range(crossentropy.CLASSES):  # a word of the class without a count stands for what its class has left
        left = 3000 / crossentropy.CLASSES - sizes[cls]
        unseen += left * math.exp(-model.losses(np.array([history, cls]), np.array([0, 0]), False)[1])
    assert total + unseen == pytest.approx(1.0)


def brute(rows, name, aimed_only):
    """Mean loss of each text under counts of all (target) texts less its own."""
    texts = [(u, crossentropy.word_hashes((t or "").encode()), a) for u, t, a in rows]
    counted = [w for _, w, a in texts if a or not aimed_only]
    vocabulary = len({w for _, own, _ in texts for w in own.tolist()})
    out = {}
    for u, own, aimed in texts:
        if not len(own):
            continue
        took, others = False, []
        for w in counted:
            if not took and (aimed or not aimed_only) and w is own:
                took = True
                continue
            others.append(w)
        pairs, words = np.zeros(crossentropy.CLASSES**2, int), {}
        for w in others:
            np.add.at(pairs, crossentropy.class_pairs(w)[2], 1)
            for x in w.tolist():
                words[x] = words.get(x, 0) + 1
        model = crossentropy.Model(pairs, vocabulary)
        out[u] = model.losses(own, np.array([words.get(x, 0) for x in own.tolist()]), False).mean()
    return out


@pytest.mark.parametrize("chunk", [1 << 25, 300])
def test_a_text_is_scored_by_the_others(spark, chunk):
    """Whole and dealt to many chunks, one text longer than a chunk, against counts of all other texts."""
    rng = random.Random(3)
    rows = [(f"t{i}", f"red green blue {i}", True) for i in range(20)] + [(f"b{i}", f"up down left {i}", False) for i in range(30)]
    rows += [(f"u{i}", " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randint(1, 40))), i % 3 == 0) for i in range(30)]
    rows += [("q1", "red green blue", False), ("q2", "up down left", False), ("n", None, None), ("e", "", True), ("long", "long words here " * 60, False)]
    df = spark.createDataFrame(rows, "URL string, `要約` string, target boolean")
    got = {r["URL"]: r for r in crossentropy.cross_entropy_difference(df, df.where("target"), chunk=chunk).collect()}
    assert got["q1"]["score"] < 0 < got["q2"]["score"] and len(got) == len(rows)
    assert (got["n"]["n_words"], got["n"]["score"], got["e"]["target_loss"]) == (0, 0.0, 0.0)
    for name, aimed_only in (("background_loss", False), ("target_loss", True)):
        for u, want in brute(rows, name, aimed_only).items():
            assert got[u][name] == pytest.approx(want)


def test_cross_entropy_of_awkward_rows(spark):
    df = articles(spark, AWKWARD)
    for target in (df.limit(0), df):
        rows = collected(crossentropy.cross_entropy_difference(df, target))
        assert len(rows) == len(AWKWARD)
        assert all(math.isfinite(r["score"]) for r in rows)
    assert crossentropy.cross_entropy_difference(df.limit(0), df).count() == 0


def test_token_counts_equal_the_library(spark):
    coder = Tokenizer.from_file(WORDS)
    for chunk in (7, 1 << 16):
        rows = collected(tokencounts.count_tokens(articles(spark, AWKWARD), WORDS, chunk=chunk))
        want = sorted((u or "", len((t or "").encode()), len(coder.encode(t or "", add_special_tokens=False).ids)) for u, t, _ in AWKWARD)
        assert sorted((r["URL"] or "", r["n_bytes"], r["n_tokens"]) for r in rows) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)
    assert tokencounts.count_tokens(articles(spark, []), WORDS).count() == 0


def test_chunk_maps_compose_in_any_tree():
    rng = random.Random(2)
    letters = "ab BIİΣσß\n\t　\x85\x1c'éñ́漢カ12½🙂<|>.,!-sStTrRéE "
    fragments = tokencounts.fragments_of(WORDS)
    coder = Tokenizer.from_file(WORDS)
    for k in range(200):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
        if k % 4 == 0:
            text = text[:40] + "<|endoftext|>" + text[40:]
        size = rng.randint(1, 30)
        maps = [tokencounts.chunk_map(text[i : i + size], fragments) for i in range(0, max(1, len(text)), size)]
        left = maps[0]
        for m in maps[1:]:
            left = tokencounts.compose(left, m, fragments)
        want = len(coder.encode(text, add_special_tokens=False).ids)
        assert tokencounts.scan(maps, fragments) == tokencounts.scan([left], fragments) == want
