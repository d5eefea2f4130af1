"""Repeated passages against brute force over all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from prismill.llm import queries, substring

from .articles import AWKWARD, articles, collected


def by_hand(texts, width=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(spark, texts, width=35):
    rows = [(f"u{i:05d}", t, "s") for i, t in enumerate(texts)]
    got = {r["URL"]: (r["n_words"], r["n_removed"], r["kept"]) for r in collected(substring.without_repeats(articles(spark, rows), width=width))}
    want = by_hand(texts, width)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[f"u{i:05d}"] == w, i
    return sum(w[1] for w in want)


def test_passages_with_every_edge(spark):
    """Passages of 34 to 120 words in different surroundings, at the ends, overlapping, shifted and chained."""
    luck = random.Random(3)
    words = lambda n, k=4000: [f"w{luck.randrange(k)}" for _ in range(n)]
    passages = [words(n) for n in (34, 35, 36, 40, 62, 63, 90, 120)]
    texts = []
    for i in range(60):
        parts = words(luck.randrange(50))
        for _ in range(luck.randrange(4)):
            p = luck.choice(passages)
            cut = luck.randrange(10) if luck.random() < 0.5 else 0
            parts += p[cut:] + words(luck.choice([0, 0, 1, 30]))
        texts.append(" ".join(parts))
    texts += [" ".join(passages[3] + words(5)) for _ in range(30)]  # one passage, 30 different ends
    texts += [" ".join(["again"] * n) for n in (34, 35, 36, 37, 200)]
    texts += [" ".join(["a", "b", "c"] * 40), " ".join(words(3000, 2))]
    assert check(spark, texts) > 1000


def test_short_windows(spark):
    luck = random.Random(4)
    texts = [" ".join(f"w{luck.randrange(3)}" for _ in range(luck.randrange(40))) for _ in range(40)]
    assert check(spark, texts, width=9) > 50


def test_awkward_rows(spark):
    given = articles(spark, AWKWARD)
    out = collected(substring.without_repeats(given))
    want = by_hand([t for _, t, _ in AWKWARD])
    assert sorted((str(r["URL"]), r["n_words"], r["n_removed"], r["kept"]) for r in out) == sorted((str(u), *w) for (u, _, _), w in zip(AWKWARD, want, strict=True))
    assert collected(substring.without_repeats(articles(spark, []))) == []


def test_query_on_the_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = by_hand([r["text"] for r in docs])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op13_substring_repeats(spark, folder).collect()}
    assert got == {r["doc_id"]: (w[0], w[1], hashlib.sha256(w[2].encode()).hexdigest()) for r, w in zip(docs, want, strict=True)}
    assert sum(w[1] for w in want) > 0


@pytest.mark.parametrize("width", [8, 35])
def test_equal_windows_have_equal_seeds(width):
    words = [f"w{i % 17}".encode() for i in range(300)]
    parsed = substring.Parsed([b" ".join(words)] * 2, width)
    half = len(parsed.seed) // 2
    assert parsed.windows.sum() == 2 * (300 - width + 1)
    assert (parsed.block[:half] == parsed.block[half:]).all() and (parsed.first[:half] == parsed.first[half:]).all()
