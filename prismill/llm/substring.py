"""Passages that articles repeat, by relative Lempel-Ziv parsing of every article against blocks of all articles."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismill.llm.common import filled, narrow, stored

#: words of the seed that names a block; every window holds at least one
SEED_WORDS = 8
#: bits of the filters that are sent to all tasks: 2 MB each. Full filters let more rows through, which a join then drops.
FILTER_BITS = 24
_BYTES = 4 << 20  # text parsed at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Parsed:
    """Some texts as one row of words, cut into blocks.

    A window is ``width`` consecutive words of one text. Its seed is the run of SEED_WORDS words with the least hash in
    it, the leftmost of equals, so equal windows have their seed at the same place. Consecutive windows with one
    seed make a block: ``first`` is the first window's start, ``windows`` their number.
    """

    def __init__(self, texts: list[bytes], width: int):
        words = [t.split() for t in texts]  # ASCII white space for bytes
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.width = width
        coded = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist(), repeat(42)), np.uint64, len(coded.dictionary))
        values = hashes[coded.indices.to_numpy()]
        n = len(values)
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:n])])
        self._back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE)]))
        text = np.repeat(np.arange(len(words)), self.lengths)
        windows = np.flatnonzero(text[: max(0, n - width + 1)] == text[width - 1 :])
        if not len(windows):
            self.text = self.first = self.windows = np.zeros(0, np.int64)
            self.seed = self.block = np.zeros(0, np.uint64)
            return
        seeds = self.hashed(np.arange(n - SEED_WORDS + 1), SEED_WORDS)
        # hash above place, so that the least is the leftmost of equals
        least = (seeds & ~np.uint64(0xFFFFFFFF)) | np.arange(len(seeds), dtype=np.uint64)
        span, reach = width - SEED_WORDS + 1, 1
        while reach < span:
            step = min(reach, span - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        place = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)]))
        begin = windows[new]
        self.windows = np.diff(np.concatenate([new, [len(windows)]]))
        self.text, self.seed = text[begin], seeds[place[new]]
        self.block = _mixed(self.hashed(begin, self.windows + width - 1) + _mixed(((place[new] - begin) * 64 + self.windows).astype(np.uint64)))
        self.first = begin - self.starts[self.text]

    def hashed(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Hash of the ``length`` words from ``at``."""
        return _mixed((self._sums[at + length] - self._sums[at]) * self._back[at])


def _named(text: bytes) -> tuple[int, int]:
    digest = md5(text, usedforsecurity=False).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts, some megabytes at a time."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(column).to_pylist()]
        at, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= _BYTES or i + 1 == len(texts):
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _slot(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class Filter:
    """A set of hashes as FILTER_BITS bits, sent to all tasks; it may hold more than the set, never less."""

    def __init__(self, hashes: DataFrame, column: str):
        slots = hashes.select(F.shiftrightunsigned(column, 64 - FILTER_BITS).alias("slot"))
        bits = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("bits"))
        found = bits.toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
        words = np.zeros(1 << FILTER_BITS - 6, np.int64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        self._sent = hashes.sparkSession.sparkContext.broadcast(words.tobytes())

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = _slot(hashes)
        words = np.frombuffer(self._sent.value, np.uint64)
        return (words[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _blocks(texts: DataFrame, width: int, known: Filter | None = None) -> DataFrame:
    """All blocks, or those whose seed may be in ``known``: seed, block, the text's digest (d1, d2), first, windows."""
    schema = pa.schema([(n, pa.int64()) for n in ("seed", "block", "d1", "d2", "first", "windows")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _groups(batches, "body"):
            parsed = Parsed(texts, width)
            keep = known.holds(parsed.seed) if known else slice(None)
            if len(text := parsed.text[keep]):
                names = np.array([_named(t) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [_signed(parsed.seed[keep]), _signed(parsed.block[keep]), pa.array(names[text, 0]), pa.array(names[text, 1]),
                     pa.array(parsed.first[keep]), pa.array(parsed.windows[keep])], schema=schema,
                )

    return texts.select("body").mapInArrow(run, "seed long, block long, d1 long, d2 long, first long, windows long")


def _packed(rows: DataFrame, known: Filter | None = None) -> DataFrame:
    """The rows with their text (``body``) compressed and named (d1, d2); those whose name may be in ``known``."""
    rest = [c for c in rows.columns if c != "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1)
        for batch, texts in _groups(batches, "body"):
            names = np.array([_named(t) for t in texts], np.int64)
            if known:
                keep = np.flatnonzero(known.holds(names[:, 0].view(np.uint64)))
                batch, texts, names = batch.take(pa.array(keep)), [texts[i] for i in keep], names[keep]
            columns = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([press.compress(t) for t in texts], pa.binary())],
                names=[*rest, "d1", "d2", "packed"],
            )

    kinds = ", ".join(f"`{n}` {kind}" for n, kind in rows.dtypes if n != "body")
    return rows.select(*rest, "body").mapInArrow(run, (kinds + ", " if kinds else "") + "d1 long, d2 long, packed binary")


def _windows(places: DataFrame, width: int) -> DataFrame:
    """Each window of the given blocks of each text: seed, window, copies, and where it starts."""
    schema = pa.schema([(n, pa.int64()) for n in ("seed", "window", "copies", "d1", "d2", "start")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1)
                parsed = Parsed([press.decompress(row.column("packed")[0].as_py())], width)
                asked = row.column("asked").flatten()
                seed, first, windows, copies = (asked.field(c).to_numpy() for c in ("seed", "first", "windows", "copies"))
                of = np.repeat(np.arange(len(first)), windows)
                start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
                both = [pa.array(np.full(len(of), row.column(d)[0].as_py(), np.int64)) for d in ("d1", "d2")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed[of]), _signed(parsed.hashed(start, width)), pa.array(copies[of]), *both, pa.array(start)], schema=schema,
                )

    return places.mapInArrow(run, "seed long, window long, copies long, d1 long, d2 long, start long")


def repeated_factors(articles: DataFrame, text: str = "要約", width: int = 35) -> DataFrame:
    """Factors of the parse: per distinct text, named by its MD5 (``d1``, ``d2``), the word spans that repeat.

    ``spans`` lists (``start``, ``end``) in words of the text, unmerged and in no order. A span is covered by windows of ``width``
    words that also start elsewhere among all texts, the same one included.

    Every text is a reference, cut into blocks by its own content (:class:`Parsed`); the index holds all blocks of all
    texts. The parse looks up each block of a text: blocks that occur twice are copied whole, and runs of them
    are the long factors. Where a factor begins or ends, the text shares a seed with other blocks but not
    the block; there the windows themselves are compared, one row per different block. Blocks, windows and texts are
    compared by hashes of 128 bits. All steps count before they move rows, so a passage in a third of all texts
    is one row per task.
    """
    texts = narrow(articles, text=text).select(filled("text").cast("binary").alias("body"))
    slots = _blocks(texts, width).groupBy(F.shiftrightunsigned("seed", 64 - 40).alias("seed40")).agg(F.count("*").alias("n")).where("n > 1")
    shared = Filter(slots.select(F.shiftleft("seed40", 64 - 40).alias("seed40")), "seed40")
    places = stored(_blocks(texts, width, shared))

    first = [F.first(c).alias(c) for c in ("d1", "d2", "first", "windows")]
    blocks = stored(places.groupBy("seed", "block").agg(F.count("*").alias("copies"), *first))
    twice = blocks.where("copies > 1").select("seed", "block")
    whole = places.join(twice, ["seed", "block"], "left_semi").select("d1", "d2", F.col("first").alias("start"), (F.col("first") + F.col("windows") + (width - 1)).alias("end"))

    # seeds with several blocks: a factor may end inside one of them
    several = blocks.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    ask = F.collect_list(F.struct("seed", "first", "windows", "copies")).alias("asked")
    asked = stored(blocks.join(several, "seed", "left_semi").groupBy("d1", "d2").agg(ask))
    some = _packed(texts, Filter(asked, "d1")).dropDuplicates(["d1", "d2"])
    windows = stored(_windows(some.join(asked, ["d1", "d2"]).select("d1", "d2", "packed", "asked"), width))
    known = stored(windows.groupBy("seed", "window").agg(F.sum("copies").alias("n")).where("n > 1").select("seed", "window"))
    single = windows.where("copies = 1").join(known, ["seed", "window"], "left_semi")
    edges = single.select("d1", "d2", "start", (F.col("start") + width).alias("end"))
    return whole.union(edges).groupBy("d1", "d2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _kept(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            counts, removed, texts = [], [], []
            for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans"), strict=True):
                words = press.decompress(packed).split()
                gone = np.zeros(len(words) + 1, np.int64)
                if spans.is_valid:
                    own = spans.values
                    np.add.at(gone, own.field("start").to_numpy(), 1)
                    np.add.at(gone, own.field("end").to_numpy(), -1)
                stay = np.cumsum(gone)[:-1] == 0
                counts.append(len(words))
                removed.append(len(words) - int(stay.sum()))
                texts.append(b" ".join(words if stay.all() else [words[i] for i in np.flatnonzero(stay)]))
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), kept], names=["id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_words long, n_removed long, kept string")


def without_repeats(articles: DataFrame, key: str = "URL", text: str = "要約", width: int = 35) -> DataFrame:
    """Each article without the words that lie in a repeated window of ``width`` words.

    Works on the articles of the feeds (``URL``, ``要約``) or on any table with an id and a text. Words are runs without ASCII white
    space, unchanged. A window repeats when its words also start anywhere else, in the same article or another; all
    its places lose their words, and windows are judged on the articles as they came. See :func:`repeated_factors`.

    Returns one row per article: the key, ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by one space.
    Null and empty texts have no words; repeated rows are copies of each other, so both lose what they
    share; keys may be null or equal, as texts are known by their digest. An empty table gives an empty result.
    """
    spans = stored(repeated_factors(articles, text, width))
    rows = narrow(articles, id=key, text=text).select("id", filled("text").cast("binary").alias("body"))
    joined = _packed(rows).join(spans, ["d1", "d2"], "left").select("id", "packed", "spans")
    return _kept(joined).withColumnRenamed("id", key)
