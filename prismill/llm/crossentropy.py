"""Score articles by the cross-entropy difference of a target and a background n-gram model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismill.llm.common import filled, narrow, stored

CLASS_BITS = 10  # words fall into 2 ** 10 classes by the low bits of their hash; class pairs are counted whole
CLASSES = 1 << CLASS_BITS
PIECES = 64  # the table of class pairs is added up in so many pieces
_START = 0  # class of a text's start
CHUNK = 1 << 25  # bytes of texts that are counted and scored together
#: weight of the class frequencies against the pairs, and count each word has before any text; both models use the same
PAIR_PRIOR, WORD_PRIOR = 8.0, 0.05


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit number per word (A-Z lower-cased): the vocabulary is every word there is."""
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def class_pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each word, of the word before it, and the number of the pair."""
    own = words & (CLASSES - 1)
    before = np.concatenate([[_START], own[:-1]])[: len(own)]
    return own, before, before << CLASS_BITS | own


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they travel: compressed, with their size."""
    press = zstandard.ZstdCompressor(1)
    for batch in batches:
        texts = [cell.as_py() or b"" for cell in batch.column(1)]
        packed = pa.array([press.compress(t) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(map(len, texts), pa.int64())], names=["id", "packed", "size"])


def _chunks(size: int) -> Callable:
    """Texts of a task in chunks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        chunk = held = 0
        for batch in batches:
            chunks = []
            for length in batch.column("size").to_pylist():
                if held and held + length > size:
                    chunk, held = chunk + 1, 0
                held += length
                chunks.append(place + chunk)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), *(batch.column(c) for c in ("id", "packed", "target"))], names=["chunk", "id", "packed", "target"])

    return run


def _tally(own: list[np.ndarray], targets: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in order, how often all texts and how often target texts have them."""
    every, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True)
    aimed = np.zeros(len(every), np.int64)
    some, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(g for g, t in zip(own, targets) if t)]), return_counts=True)
    aimed[np.searchsorted(every, some)] = n
    return every, counts.astype(np.int64), aimed


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each chunk, a row each, and the class pairs of all the task's texts as pieces of two tables: the map side of the counts."""
    press = zstandard.ZstdDecompressor()
    words, targets, current = [], [], None
    grid = np.zeros((2, CLASSES * CLASSES), np.int64)
    names = ["chunk", "number", "background", "target", "grid"]

    def done() -> Iterator[pa.RecordBatch]:
        every, counts, aimed = _tally(words, targets)
        for at in range(0, len(every), 1 << 16):
            part = slice(at, at + (1 << 16))
            n = len(every[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, current, np.int64)), pa.array(every[part]), pa.array(counts[part]), pa.array(aimed[part]), pa.nulls(n, pa.binary())], names=names
            )

    for batch in batches:
        for chunk, packed, target in zip(batch.column("chunk").to_pylist(), batch.column("packed"), batch.column("target").to_pylist()):
            if chunk != current:
                yield from done() if words else ()
                words, targets, current = [], [], chunk
            own = word_hashes(press.decompress(packed.as_py()))
            if len(own):
                words.append(own)
                targets.append(target)
                pairs, times = np.unique(class_pairs(own)[2], return_counts=True)
                grid[0, pairs] += times
                if target:
                    grid[1, pairs] += times
    yield from done() if words else ()
    if current is not None:
        task, zero, squeeze = TaskContext.get().partitionId(), pa.array([0], pa.int64()), zstandard.ZstdCompressor(1)
        for i, piece in enumerate(np.split(grid, PIECES, axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([i], pa.int64()), zero, zero, pa.array([squeeze.compress(np.ascontiguousarray(piece).tobytes())], pa.binary())], names=names)


def _summed(tables: DataFrame, tasks: int) -> np.ndarray:
    """The sum of all tasks' tables (``task``, ``piece``, ``grid``): 64 tables at a time, piece by piece, until one is left."""

    def add(group: pa.Table) -> pa.Table:
        press, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(1)
        total = np.zeros(2 * CLASSES * CLASSES // PIECES, np.int64)
        for g in group.column("grid"):
            total += np.frombuffer(press.decompress(g.as_py()), np.int64)
        return pa.table({"task": group.column("task")[:1], "piece": group.column("piece")[:1], "grid": pa.array([squeeze.compress(total.tobytes())], pa.binary())})

    while True:
        tables = tables.withColumn("task", F.floor(F.col("task") / 64)).groupBy("task", "piece").applyInArrow(add, "task long, piece long, grid binary")
        if tasks <= 64:
            break
        tables, tasks = stored(tables), -(-tasks // 64)
    out = np.zeros((2, PIECES, CLASSES * CLASSES // PIECES), np.int64)
    for r in tables.collect():  # PIECES rows
        out[:, r["piece"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["grid"]), np.int64).reshape(2, -1)
    return out.reshape(2, -1)


@dataclass
class Model:
    """Counts of one corpus: class pairs, and how many different words both corpora have."""

    pairs: np.ndarray  # CLASSES x CLASSES, flat
    vocabulary: int

    def __post_init__(self):
        grid = self.pairs.reshape(CLASSES, CLASSES)
        self.after = grid.sum(axis=1)  # pairs that start with a class
        self.classes = grid.sum(axis=0)  # words of a class
        self.total = int(self.classes.sum())

    def losses(self, words: np.ndarray, counts: np.ndarray, own: bool) -> np.ndarray:
        """Negative log probability of each word, whose count is in ``counts``; ``own``: less what the text itself counts."""
        cls, before, pair = class_pairs(words)
        found = np.stack([self.pairs[pair], counts, self.classes[cls], self.after[before]]).astype(float)
        total = self.total
        if own:
            found -= np.stack([_times(pair), _times(words), _times(cls), _times(before)])
            total -= len(words)
        pairs, single, in_class, after = found
        share = (in_class + 1) / (total + CLASSES)
        followed = (pairs + PAIR_PRIOR * share) / (after + PAIR_PRIOR)
        within = (single + WORD_PRIOR) / (in_class + WORD_PRIOR * max(1.0, self.vocabulary / CLASSES))
        return -np.log(followed) - np.log(within)


def _times(numbers: np.ndarray) -> np.ndarray:
    """How often the text itself has each of its numbers."""
    _, inverse, counts = np.unique(numbers, return_inverse=True, return_counts=True)
    return counts[inverse]


def _score(sent) -> Callable:
    """Scores of a chunk's texts: its own words are counted again, those other chunks have too come as totals."""

    def run(texts: pa.Table, shared: pa.Table) -> pa.Table:
        background, target = sent.value
        press = zstandard.ZstdDecompressor()
        own, targets = [word_hashes(press.decompress(t.as_py())) for t in texts.column("packed")], texts.column("target").to_pylist()
        every, counts, aimed = _tally(own, targets)
        at = np.searchsorted(every, shared.column("number").to_numpy())
        counts[at] = shared.column("background").to_numpy()
        aimed[at] = shared.column("target").to_numpy()
        rows = []
        for words, known in zip(own, targets):
            if not len(words):
                rows.append((0, 0.0, 0.0, 0.0))
                continue
            place = np.searchsorted(every, words)
            t = float(target.losses(words, aimed[place], known).mean())
            b = float(background.losses(words, counts[place], True).mean())
            rows.append((len(words), t, b, t - b))
        columns = list(zip(*rows)) if rows else [()] * 4
        types = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table([texts.column("id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["id", "n_words", "target_loss", "background_loss", "score"])

    return run


def cross_entropy_difference(articles: DataFrame, target: DataFrame, key: str = "URL", text: str = "要約", chunk: int = CHUNK) -> DataFrame:
    """Loss per word of each article under a model of the target articles, less that under a model of all.

    Works on the articles of the feeds (``URL``, ``要約``) or on any table with an id and a text; ``target`` has the keys of the
    target articles. The background model counts every article, the target model every target article. Both are class bigrams over
    one vocabulary, all words of all articles: the chance of a word is that of its class after the class before it, times
    that of the word within its class. Class pairs are 2 ** 20 counts at any size, a table sent to all tasks; word
    counts are a keyed table that grows with the corpus. Texts are counted in chunks; a word's sums go back to
    the chunks that have it, and those of a word of one chunk only never leave it. An article's own words are taken
    out of the counts that score it.

    Returns one row per article: the key, ``n_words``, ``target_loss``, ``background_loss`` and ``score``, their difference: the lower,
    the more like the target. Texts without words, null or empty, have losses and score 0; repeated rows score alike;
    without target articles the target model is even. An empty table gives an empty result.
    """
    names = target.select(target[f"`{key}`"].alias("name")).where("name is not null").distinct()
    rows = narrow(articles, id=key, text=text).select("id", filled("text").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.mapInArrow(_packed, f"id {kind}, packed binary, size long").join(names, F.col("id") == F.col("name"), "left")
    rows = rows.select("id", "packed", "size", F.col("name").isNotNull().alias("target"))
    # stored, so that a chunk holds the same texts when it is counted and when it is scored
    dealt = stored(rows.mapInArrow(_chunks(chunk), f"chunk long, id {kind}, packed binary, target boolean"))
    counts = dealt.select("chunk", "packed", "target").mapInArrow(_count, "chunk long, number long, background long, target long, grid binary")
    counts = stored(counts)
    tables = counts.where("grid IS NOT NULL").select(F.col("chunk").alias("task"), F.col("number").alias("piece"), "grid")
    grids = _summed(tables, 1 + (tables.agg(F.max("task")).first()[0] or 0))
    words = counts.where("grid IS NULL")
    totals = words.groupBy("number").agg(*[F.sum(c).alias(c) for c in ("background", "target")], F.count("*").alias("chunks"))
    totals = stored(totals)
    vocabulary = totals.count()
    sent = articles.sparkSession.sparkContext.broadcast(tuple(Model(grid, vocabulary) for grid in grids))
    known = words.select("chunk", "number")
    shared = known.join(totals.where("chunks > 1").select("number", "background", "target"), "number").select("chunk", "number", "background", "target")
    scored = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(
        _score(sent), f"id {kind}, n_words long, target_loss double, background_loss double, score double"
    )
    return scored.withColumnRenamed("id", key)
