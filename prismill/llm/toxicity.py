"""Toxic spans and document scores by a linear-chain conditional random field."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismill.llm.common import filled, narrow
from prismill.session import cut_lineage

WORDS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5)  # lengths of the word starts that are features beside the word
LABEL_ROWS = 40_000  # labelled articles, at most, that are learnt from
FIT_ROWS = 6000  # those of them, at most, whose tokens fit the chain and the score


@dataclass
class Field:
    """A fitted field: evidence of words and word starts, weights of the two tags, and the document score."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 + len(STEMS)))  # bias, word, stems
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))

    @property
    def gate(self) -> set[str]:
        return {w[: STEMS[0]] for w in (*self.words, *self.stems)}


# --- evidence -----------------------------------------------------------------------


def _features(words: set[str]) -> set[tuple[int, str]]:
    out = {(0, w) for w in words}
    for n in STEMS:
        out |= {(n, w[:n]) for w in words if len(w) >= n}
    return out


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Articles per feature, part and label in this task: the map side of the count."""
    counts = [Counter() for _ in range(4)]
    total = [0] * 4

    def flush() -> pa.RecordBatch:
        keys = list(set().union(*counts))
        rows = [*((k, w, *[c[k, w] for c in counts]) for k, w in keys), (-1, "", *total)]
        for c in counts:
            c.clear()
        total[:] = [0] * 4
        types = [pa.int32(), pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["kind", "feature", *_COUNTS])

    for batch in batches:
        for text, cell in zip(batch.column(0), batch.column(1).to_pylist()):
            counts[cell].update(_features(set(WORDS.findall(text.as_py().lower()))))
            total[cell] += 1
        if sum(map(len, counts)) > 1_000_000:
            yield flush()
    yield flush()


_COUNTS = ["clean_0", "toxic_0", "clean_1", "toxic_1"]  # part 1 fits the field and the score


def _evidence(labelled: DataFrame, least: int, ratio: float) -> tuple[list[tuple[dict, dict]], list[int]]:
    """Words and word starts that at least ``least`` toxic articles and ``ratio`` times as large a share of them as of clean ones have.

    First by the rows of part 0, to fit with, then by all. At most toxic rows * words / ``least`` features pass; words that occur
    this unevenly are the lexicon of the offence, which does not grow with the table.
    """
    cell = (2 * F.col("part") + F.col("label")).cast("int").alias("cell")
    names = ", ".join(f"{c} long" for c in _COUNTS)
    counts = labelled.select("text", cell).mapInArrow(_count_features, f"kind int, feature string, {names}")
    counts = counts.groupBy("kind", "feature").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    rows = counts.where((F.col("kind") < 0) | (F.col("toxic_0") + F.col("toxic_1") >= least))
    counts = cut_lineage(rows)
    row = counts.where("kind = -1").first()
    c0, t0, c1, t1 = [row[c] for c in _COUNTS] if row else [0] * 4
    out = []
    for clean, toxic, n0, n1 in (
        (F.col("clean_0"), F.col("toxic_0"), c0, t0), (F.col("clean_0") + F.col("clean_1"), F.col("toxic_0") + F.col("toxic_1"), c0 + c1, t0 + t1)
    ):
        odds = F.log((toxic + 0.5) / F.lit(n1 + 1.0)) - F.log((clean + 0.5) / F.lit(n0 + 1.0))
        found = counts.where((F.col("kind") >= 0) & (toxic >= least)).select("kind", "feature", odds.alias("odds")).where(F.col("odds") > math.log(ratio)).collect()
        out.append(({r["feature"]: r["odds"] for r in found if r["kind"] == 0}, {r["feature"]: r["odds"] for r in found if r["kind"] > 0}))
    return out, [c0 + c1, t0 + t1]


# --- the chain ----------------------------------------------------------------------


def events(words: list[str], model: Field, gate: set[str]) -> tuple[list[int], np.ndarray]:
    """Places of the words with evidence and their feature values; all others look alike to the field."""
    places, values = [], []
    n = STEMS[0]
    for i, w in enumerate(words):
        if w[:n] in gate:
            row = [1.0, model.words.get(w, 0.0), *[model.stems.get(w[:k], 0.0) if len(w) >= k else 0.0 for k in STEMS]]
            if any(row[1:]):
                places.append(i)
                values.append(row)
    return places, np.array(values).reshape(-1, 2 + len(STEMS))


def _power(step: np.ndarray, n: int, memo: dict[int, np.ndarray]) -> np.ndarray:
    """``step`` to the n-th power, scaled to a sum of 1: marginals don't see the scale."""
    if n not in memo:
        out, square, m = np.eye(2), step / step.sum(), n
        while m:
            if m & 1:
                out = out @ square
                out = out / out.sum()
            square, m = square @ square, m >> 1
            square = square / square.sum()
        if len(memo) > 100_000:
            memo.clear()
        memo[n] = out
    return memo[n]


class Chain:
    """Forward-backward over a text whose words without evidence are stretches of one matrix power."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights = weights
        self.move = np.exp(transitions)
        self.plain = np.array([1.0, math.exp(weights[0])])  # potentials of a word without evidence
        self.step = self.move * self.plain[None, :]
        self.memo: dict[int, np.ndarray] = {}

    def run(self, places: list[int], values: np.ndarray, n: int) -> np.ndarray:
        """Toxic marginals at the places of a text of n words."""
        k = len(places)
        own = np.ones((k, 2))
        own[:, 1] = np.exp(np.clip(values @ self.weights, -50, 50))
        gaps = [places[0], *(b - a - 1 for a, b in zip(places, places[1:])), n - places[-1] - 1]
        between = [_power(self.step, g, self.memo) for g in gaps]
        forward = np.zeros((k, 2))
        state = np.array([0.5, 0.5])
        for i in range(k):
            state = (state @ between[i] @ self.move) * own[i]
            state = state / state.sum()
            forward[i] = state
        back = between[k].sum(axis=1)
        out = np.zeros(k)
        for i in range(k - 1, -1, -1):
            both = forward[i] * back
            out[i] = both[1] / both.sum()
            back = between[i] @ (self.move @ (own[i] * back))
            back = back / back.sum()
        return out


def _fit_chain(texts: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of largest penalised likelihood of the tags, by gradient steps over windows of the texts."""
    width = texts[0][0].shape[1]
    w, t = np.zeros(width), np.zeros((2, 2))
    w[0] = -2.0
    size = max(len(x) for x, _ in texts)
    n = len(texts)
    x = np.zeros((n, size, width))
    y = np.zeros((n, size), int)
    real = np.zeros((n, size), bool)
    for i, (a, b) in enumerate(texts):
        x[i, : len(a)], y[i, : len(b)], real[i, : len(a)] = a, b, True
    moment_w, moment_t = np.zeros_like(w), np.zeros_like(t)
    square_w, square_t = np.zeros_like(w), np.zeros_like(t)
    tokens = real.sum()
    seen_t = np.zeros((2, 2))
    pair_real = real[:, 1:] & real[:, :-1]
    for a in (0, 1):
        for b in (0, 1):
            seen_t[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & pair_real).sum()
    seen_w = np.einsum("nsw,ns->w", x, y * real)
    for step in range(1, rounds + 1):
        own = np.stack([np.zeros((n, size)), np.clip(x @ w, -50, 50)], axis=2)
        own = np.exp(own)
        move = np.exp(t)
        f = np.zeros((n, size, 2))
        scale = np.ones((n, size))
        state = own[:, 0] * 0.5
        for s in range(size):
            if s:
                nxt = (state @ move) * own[:, s]
                state = np.where(real[:, s, None], nxt, state)
            scale[:, s] = state.sum(axis=1)
            state = state / scale[:, s, None]
            f[:, s] = state
        b = np.ones((n, 2))
        expect_t = np.zeros((2, 2))
        marg = np.zeros((n, size))
        for s in range(size - 1, -1, -1):
            both = f[:, s] * b
            both /= both.sum(axis=1, keepdims=True)
            marg[:, s] = both[:, 1]
            if s:
                right = own[:, s] * b
                pair = f[:, s - 1, :, None] * move[None] * right[:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                expect_t += pair[real[:, s]].sum(axis=0)
                nb = right @ move.T
                nb /= nb.sum(axis=1, keepdims=True)
                b = np.where(real[:, s, None], nb, b)
        grad_w = (seen_w - np.einsum("nsw,ns->w", x, marg * real)) / tokens * 10 - ridge * w
        grad_t = (seen_t - expect_t) / tokens * 10 - ridge * t
        for grad, moment, square, value in ((grad_w, moment_w, square_w, w), (grad_t, moment_t, square_t, t)):
            moment += 0.1 * (grad - moment)
            square += 0.01 * (grad * grad - square)
            value += rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8) * 0.3
    return w, t


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Ridge logistic weights by Newton steps; the first is the bias."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - 0.1 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


def _best_cut(z: np.ndarray, y: np.ndarray, clean_weight: float) -> float:
    """The value of ``z`` from which calling a text toxic gives the best F1; a clean text counts ``clean_weight`` times."""
    order = np.argsort(-z, kind="stable")
    hit, false = np.cumsum(y[order]), np.cumsum((1 - y[order]) * clean_weight)
    last = np.append(np.diff(z[order]) != 0, True)  # ties stand together
    f1 = np.where(last, 2 * hit / (hit + false + y.sum()), 0.0)
    best = int(np.argmax(f1))
    below = z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1.0
    return float((z[order][best] + below) / 2)


def summary(marginals: np.ndarray, n: int) -> list[float]:
    """What the score of a text sees: expected toxic words, and the log odds of the likeliest one."""
    if not len(marginals):
        return [0.0, -8.0]
    most = min(max(float(marginals.max()), 1e-4), 1 - 1e-4)
    return [math.log1p(float(marginals.sum())), max(-8.0, math.log(most / (1 - most)))]


def labelled_articles(articles: DataFrame, labels: DataFrame, toxic: str, key: str, text: str, label_rows: int) -> tuple[DataFrame, list[int]]:
    """Texts of at most ``label_rows`` labelled articles, half of each label as far as there are, and the counts of all labels.

    Only keys and labels compete (those with the smallest hash win); the winners, a bounded set, are sent to where the
    texts are, so no text is moved.
    """
    known = labels.select(labels[f"`{key}`"].alias("name"), labels[f"`{toxic}`"].cast("int").alias("label")).where("label in (0, 1) and name is not null")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    halves = [known.where(F.col("label") == v).orderBy(F.xxhash64("name"), "name").limit(label_rows // 2) for v in (0, 1)]
    chosen = F.broadcast(halves[0].union(halves[1]).distinct())
    rows = articles.select(articles[f"`{key}`"].alias("id"), filled(articles[f"`{text}`"]).alias("text"))
    return cut_lineage(rows.join(chosen, F.col("id") == F.col("name")).select("id", "text", "label")), [counts.get(v, 0) for v in (0, 1)]


def fit_field(
    articles: DataFrame, labels: DataFrame, toxic: str = "toxic", text: str = "要約", key: str = "URL", least: int = 5, ratio: float = 20.0,
    label_rows: int = LABEL_ROWS, fit_rows: int = FIT_ROWS, threshold: float = 0.7,
) -> Field:
    """Fit the field to articles whose keys ``labels`` has with a 0/1 column ``toxic``; other labels are left out.

    At most ``label_rows`` labelled articles are learnt from. Words and word starts that are ``ratio`` times as frequent in
    toxic ones are counted; they label the tokens: a token of a toxic article is toxic where the evidence for its word or
    start is strong. Chain and score are fitted on a third of the rows, at most ``fit_rows``, with the evidence of the others only,
    so that they see words as a new text shows them; the cut with the best F1 among them is at ``threshold``. Without
    both labels the field scores everything alike, below one half.
    """
    labelled, (all0, all1) = labelled_articles(articles, labels, toxic, key, text, label_rows)
    # equal texts fall into one part
    labelled = labelled.withColumn("part", F.when(F.pmod(F.xxhash64("text"), F.lit(3)) == 0, F.lit(1)).otherwise(F.lit(0)))
    (first, whole), (n0, n1) = _evidence(labelled, least, ratio)
    model, final = Field(*first), Field(*whole)
    if not n0 or not n1 or not any(first):
        return final
    luck = F.xxhash64("id", "text")
    sample = []
    for value in (0, 1):
        one = labelled.where((F.col("label") == value) & (F.col("part") == 1)).select("id", "text", luck.alias("luck"))
        rows = one.orderBy("luck", "id").limit(fit_rows // 2).mapInArrow(_sequences(model), "places array<int>, features array<double>, n int")
        sample += [(value, r["places"], np.array(r["features"]).reshape(-1, 2 + len(STEMS)), r["n"]) for r in rows.collect()]
    texts = []
    strong = math.log(ratio)
    for value, places, values, n in sample:
        if not places:
            continue
        # a window around the evidence is enough: the rest of the text looks alike
        lo, hi = max(0, places[0] - 20), min(n, places[0] + 80)
        inside = [i for i, p in enumerate(places) if lo <= p < hi]
        x = np.zeros((hi - lo, values.shape[1]))
        x[:, 0] = 1.0
        at = [places[i] - lo for i in inside]
        x[at] = values[inside]
        y = np.zeros(hi - lo, int)
        if value:
            y[at] = (values[inside, 1:].max(axis=1) > strong).astype(int)
        texts.append((x, y))
    if texts:
        model.weights, model.transitions = _fit_chain(texts[:2000])
    chain = Chain(model.weights, model.transitions)
    seen = np.array([summary(chain.run(p, v, n) if p else np.zeros(0), n) for _, p, v, n in sample])
    truth = np.array([value for value, *_ in sample], float)
    model.score = _logistic(seen, truth)
    # the sample has more toxic articles than the table: move the best cut to the threshold
    sampled = max(truth.sum(), 1.0), max(len(truth) - truth.sum(), 1.0)
    cut = _best_cut(model.score[0] + seen @ model.score[1:], truth, (all0 / sampled[1]) / (all1 / sampled[0]))
    model.score[0] += math.log(threshold / (1 - threshold)) - cut
    final.weights, final.transitions, final.score = model.weights, model.transitions, model.score
    return final


def _sequences(model: Field) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = model.gate
        for batch in batches:
            rows = []
            for text in batch.column(batch.schema.get_field_index("text")):
                words = WORDS.findall(text.as_py().lower())
                places, values = events(words, model, gate)
                rows.append((places, values.ravel().tolist(), len(words)))
            names, types = ["places", "features", "n"], [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return run


# --- scoring ------------------------------------------------------------------------


def _scores(model: Field, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate, chain = model.gate, Chain(model.weights, model.transitions)
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1):
                text = text.as_py()
                low = text.lower()
                if len(low) != len(text):  # offsets must be the text's own
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                words = WORDS.findall(low)
                places, values = events(words, model, gate)
                marginals = chain.run(places, values, len(words)) if places else np.zeros(0)
                z = model.score[0] + float(np.dot(model.score[1:], summary(marginals, len(words))))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                found = {p: float(m) for p, m in zip(places, marginals) if m >= threshold}
                own: list[dict] = []
                if found:
                    own = [{"start": m.start(), "end": m.end(), "marginal": found[i]} for i, m in enumerate(WORDS.finditer(low)) if i in found]
                spans.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], names=["id", "score", "spans"])

    return run


def score_toxicity(articles: DataFrame, model: Field, key: str = "URL", text: str = "要約", threshold: float = 0.7) -> DataFrame:
    """Score every article and mark its toxic words.

    Works on the articles of the feeds (``URL``, ``要約``) or on any table with an id and a text. Forward-backward over
    all words of the whole text gives each word's chance of being toxic; words without evidence are alike, so a
    stretch of them is one matrix power, whatever its length. Nothing is shuffled.

    Returns one row per article: the key, ``score`` (0 to 1), ``predicted`` (1 if the score reaches ``threshold``) and
    ``spans`` (start, end and marginal of words whose marginal reaches it, in code points of the text). Null and empty
    texts score as a text without evidence; repeated rows score alike. An empty table gives an empty result.
    """
    rows = narrow(articles, id=key, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.select("id", filled("text").alias("text")).mapInArrow(
        _scores(model, threshold), f"id {kind}, score double, spans array<struct<start: int, end: int, marginal: double>>"
    )
    return scored.select(F.col("id").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def without_toxic(articles: DataFrame, model: Field, key: str = "URL", text: str = "要約", threshold: float = 0.7) -> DataFrame:
    """The articles, all columns, that :func:`score_toxicity` does not predict toxic: one narrow pass, no shuffle."""
    names = [f.name for f in articles.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in articles.schema)
    at = names.index(text)
    score = _scores(model, threshold)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).fill_null("")
            (scored,) = score(iter([pa.RecordBatch.from_arrays([pa.nulls(len(texts)), texts], names=["id", "text"])]))
            yield batch.filter(pa.compute.less(scored.column(1), threshold))

    return articles.mapInArrow(keep, schema)
