"""Exact and near copies against brute force and on awkward rows."""

import hashlib
import re

import numpy as np
import pytest

from prismill.llm import exact, simhash
from tests.llm.articles import AWKWARD, LONG, articles, collected


def test_exact_copies_on_awkward_rows(spark):
    rows = collected(exact.exact_copies(articles(spark, AWKWARD)))
    assert len(rows) == len(AWKWARD)
    body = {t: re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in AWKWARD}
    groups = {}
    for url, t, _ in AWKWARD:
        groups.setdefault(body[t], []).append((-len(t or ""), url is None, url or "", url))
    by_hash = {hashlib.sha256(b.encode()).hexdigest(): sorted(g) for b, g in groups.items()}
    for r in rows:
        group = by_hash[r["text_sha256"]]
        assert r["group_size"] == len(group)
        assert r["keep_id"] == group[0][3]
    kept = [r["text_sha256"] for r in rows if r["kept"]]
    assert sorted(kept) == sorted(by_hash)  # one of each text, of repeated rows too


def test_exact_copies_of_nothing(spark):
    assert collected(exact.exact_copies(articles(spark, []))) == []


def test_chunks_spell_the_text(spark):
    df = spark.createDataFrame([(LONG,), ("",), ("x" * 10_000,), ("漢字🙂" * 5000,)], "t string")
    for r in df.select(exact.squeezed("t").alias("s"), exact.chunks(exact.squeezed("t")).alias("c")).collect():
        assert "".join(r["c"]) == r["s"]
        assert all(0 < len(c) <= exact.MAX for c in r["c"])


def test_a_shared_number_is_noticed_and_told_apart(spark, monkeypatch):
    pieces = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "chunk string")
    assert exact.shared_numbers(pieces).count() == 0
    import pyspark.sql.functions as F

    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    assert [r["number"] for r in exact.shared_numbers(pieces).collect()] == [5]
    rows = collected(exact.exact_copies(articles(spark, [("u1", "aaa", "s"), ("u2", "bbb", "s"), ("u3", "b bb", "s")])))
    assert {r["URL"]: r["keep_id"] for r in rows} == {"u1": "u1", "u2": "u3", "u3": "u3"}


def test_without_copies_keeps_all_columns(spark):
    df = articles(spark, AWKWARD)
    kept = exact.without_copies(df)
    assert kept.columns == df.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["要約"] or "") for r in kept.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in AWKWARD})


def _components(prints, radius):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def _crowd(seed, n, spread):
    """Distinct fingerprints around a few centres, so that places are crowded."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 3, dtype=np.uint64)
    out = set()
    while len(out) < n:
        bits = rng.choice(64, rng.integers(0, spread + 1), replace=False)
        out.add(int(rng.choice(centres)) ^ sum(1 << int(b) for b in bits))
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize("size", [1, 2, 63, 64, 65, 300])
def test_blocks_equal_brute_force(size):
    blocks = [_crowd(s, n, 6) for s, n in ((0, size), (1, 2), (2, 70))]
    row, root = simhash.links_in_blocks(np.concatenate(blocks), np.array([len(b) for b in blocks]), 4)
    label = list(range(sum(map(len, blocks))))
    for r, to in zip(row.tolist(), root.tolist()):
        label[r] = to
    at = 0
    for b in blocks:
        assert [x - at for x in label[at : at + len(b)]] == _components(b, 4)
        at += len(b)


def test_links_through_crowded_places(spark):
    """Places over the block size are cut anew, and no link is lost."""
    prints = _crowd(3, 600, 7)
    df = spark.createDataFrame([(int(p.astype(np.int64)),) for p in prints], "print long")
    links = simhash.near_links(df, radius=4, block=16).collect()
    index = {int(p.astype(np.int64)): i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for link in links:
        assert (link["a"] & (2**64 - 1) ^ link["b"] & (2**64 - 1)).bit_count() <= 64
        a, b = find(index[link["a"]]), find(index[link["b"]])
        parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(prints))] == _components(prints, 4)


def test_near_copies_on_awkward_rows(spark):
    rows = collected(simhash.near_copies(articles(spark, AWKWARD)))
    assert len(rows) == len(AWKWARD)
    of = {(r["URL"]): r for r in rows}
    assert of["https://a.example/4"]["fingerprint"] == "0" * 16
    for name in "456":  # without words: one component, in which the null key is never the smallest
        assert of[f"https://a.example/{name}"]["component_id"] == "https://a.example/4"
    for name in "123":
        assert of[f"https://a.example/{name}"]["component_id"] == "https://a.example/1"
    assert of["https://a.example/8"]["component_id"] == "https://a.example/7"
    assert simhash.near_copies(articles(spark, [])).count() == 0


def test_one_near_copy_stays(spark):
    kept = simhash.without_near_copies(articles(spark, AWKWARD))
    urls = [r["URL"] for r in kept.collect()]
    assert sorted(u for u in urls if u) == [f"https://a.example/{i}" for i in (1, 4, 7, 9)]
    assert urls.count(None) == 2  # without a key they can't be told apart
