"""Mixing and packing: balances, unbiased draws, exact ids and gapless sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prismill.llm import mixing, packing
from tests.llm.articles import AWKWARD, articles, collected

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_pivot_keeps_words_and_expectation():
    rng = np.random.default_rng(0)
    size = np.sort(rng.integers(1, 60, 80))[::-1].astype(float)
    share = rng.uniform(0.05, 0.95, 80)
    total, runs = np.zeros(80), 6000
    for _ in range(runs):
        out, held = mixing.pivot(size, share, rng.random(80), last=False)
        assert abs((out * size).sum() - (share * size).sum()) < 1e-6
        assert ((out == 0) | (out == 1) | (np.arange(80) == held)).all()
        total += out
    assert np.abs(total / runs - share).max() < 0.035


def test_targets_stop_at_three_times_the_source(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 500), ("d", 0), (None, 100)]
    df = spark.createDataFrame(sizes, "source string, source_size long")
    got = {r["source"]: (r["weight"], r["target"]) for r in mixing.target_sizes(df).collect()}
    weights, left = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, dict(sizes)
    fixed, total = {}, sum(left.values())
    while True:  # share, stop, share anew
        rate = (total - sum(fixed.values())) / sum(w for s, w in weights.items() if s not in fixed)
        above = [s for s in weights if s not in fixed and rate * weights[s] > 3 * left[s]]
        if not above:
            break
        fixed |= {s: 3.0 * left[s] for s in above}
    assert {s: w for s, (w, _) in got.items()} == weights
    for s, w in weights.items():
        assert got[s][1] == pytest.approx(fixed.get(s, rate * w))


def _many(n):
    rng = np.random.default_rng(4)
    return [(f"u{i:05d}", " ".join(["w"] * int(rng.integers(1, 30))), "abc"[min(2, i % 5)]) for i in range(n)]


@pytest.mark.parametrize("segment", [8192, 16])
def test_mix_meets_its_targets(spark, monkeypatch, segment):
    monkeypatch.setattr(mixing, "SEGMENT", segment)
    rows = _many(900)
    df = articles(spark, rows)
    got = collected(mixing.mix_sources(df))
    again = collected(mixing.mix_sources(df.repartition(5)))
    key = lambda r: r["URL"]
    assert sorted(got, key=key) == sorted(again, key=key)
    source = {u: s for u, _, s in rows}
    for s in "abc":
        own = [r for r in got if source[r["URL"]] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 30
    assert all(r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in got)


def test_mix_on_awkward_rows(spark):
    rows = collected(mixing.mix_sources(articles(spark, AWKWARD)))
    assert len(rows) == len(AWKWARD)
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode().split()) for _, t, _ in AWKWARD)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix_sources(articles(spark, [])).count() == 0


def test_mixed_articles_come_as_often_as_drawn(spark):
    df = articles(spark, _many(200))
    drawn = {r["URL"]: r["copies"] for r in mixing.mix_sources(df).collect()}
    out = mixing.mixed_articles(df)
    assert out.columns == df.columns
    seen = {}
    for r in out.collect():
        seen[r["URL"]] = seen.get(r["URL"], 0) + 1
    assert seen == {u: n for u, n in drawn.items() if n}


def _check_packing(rows, texts, length):
    coder = Tokenizer.from_file(BYTES)
    by_key = {}
    for r in rows:
        by_key.setdefault(r["URL"], []).append(r)
    wanted = {}
    for url, t, _ in texts:
        wanted.setdefault(url, []).append(np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    for url, ids in wanted.items():
        found = by_key.pop(url)
        assert sum(r["length"] for r in found) == sum(map(len, ids))
        if len(ids) == 1:
            for r in sorted(found, key=lambda r: r["piece"]):
                part = ids[0][r["start"] : r["start"] + r["length"]]
                assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
                assert r["piece"] == 0 or r["length"] == length
    assert not by_key
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    return len(places)


def test_packing_awkward_rows(spark):
    rows = collected(packing.pack_articles(articles(spark, AWKWARD), BYTES, length=64))
    n = _check_packing(rows, AWKWARD, 64)
    assert n <= -(-sum(r["length"] for r in rows) // 64) + 3
    assert packing.pack_articles(articles(spark, []), BYTES).count() == 0


def test_packing_by_many_tasks_meets_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 40)
    texts = _many(400)
    rows = collected(packing.pack_articles(articles(spark, texts), BYTES, length=48, open_bins=8))
    n = _check_packing(rows, texts, 48)
    assert n <= 1.15 * -(-sum(r["length"] for r in rows) // 48)


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 8)] == [(0, 0), (1, 0), (1, 7), (2, 0)]  # 7 + 3 is full and gone
    assert bins.place(9) == (3, 0)  # two are open: the one with 8 closes
    assert bins.place(4) == (0, 6)
    assert sorted(bins.left()) == [(3, 9)]


@pytest.mark.parametrize("text", ["a  b", " a b ", "a\n b\nc", "x <|endoftext|> y", "don't\tstop", "é 漢字 🙂", "a　b \x1c c", "\n\n a", "a ", "a\nb\n", "\na b\nc d", "a\n\n\nb c", "\n", "a\n\nb c\n\n", " ", "a\n<|endoftext|>\nb"])
def test_word_ids_equal_the_library(text):
    ids = np.frombuffer(packing.word_ids(BYTES)(text), "<u4").tolist()
    assert ids == Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids


def test_texts_without_a_key_or_under_one_are_each_taken(spark):
    """With one source every row is taken once, whatever its key."""
    rows = [(None, f"nameless text {i}", "alpha") for i in range(30)] + [("u", f"text {i} under one key", "alpha") for i in range(30)]
    out = collected(mixing.mixed_articles(articles(spark, rows), weights=(1.0,)))
    assert sorted(r["要約"] for r in out) == sorted(t for _, t, _ in rows)
