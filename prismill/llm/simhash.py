"""Near copies of articles by SimHash fingerprints, compared through bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from prismill.llm.common import filled, narrow
from prismill.operators.clustering import connected_components
from prismill.session import cut_lineage

BITS = 64
SEED = 42
_STRETCH = 1 << 16  # shingles whose bits are held at a time
_LANES = 1 << 15  # words of 64 comparisons done at a time
_BATCH = 1 << 13  # fingerprints whose planes are built at a time


# --- fingerprints -------------------------------------------------------------------


def fingerprint(text: bytes, width: int = 4) -> int:
    """The bits that more than half of the text's word shingles have set; 0 without words."""
    words = text.lower().split()  # both are ASCII-only for bytes
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    counts = np.zeros(BITS, np.int64)
    for _ in range(0, n, _STRETCH):
        part = np.fromiter(islice(hashes, _STRETCH), np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):  # a byte holds a sum of 255
            counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return text.map(lambda t: np.uint64(fingerprint(t)).astype(np.int64))


# --- comparison in blocks -----------------------------------------------------------


def _within(planes: np.ndarray, word: np.ndarray, query: np.ndarray, open_: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries and lanes that differ from their query in at most ``radius`` bits.

    An entry is a word of 64 lanes and one query. Vertical counters of all 64 distances start at a value
    from which the (radius + 1)-th difference carries out of the top; entries whose lanes have all
    carried are abandoned.
    """
    digits = radius.bit_length()
    start = (1 << digits) - 1 - radius
    at = np.arange(len(word))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    counters = [np.full(len(word), full if start >> i & 1 else 0, np.uint64) for i in range(digits)]
    for b in range(BITS):
        carry = planes[b][word] ^ (np.uint64(0) - (query >> np.uint64(b) & np.uint64(1)))
        for i in range(digits):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        open_ = open_ & ~carry
        if b % 8 == 7:
            live = open_ != 0
            if not live.all():
                at, word, query, open_ = at[live], word[live], query[live], open_[live]
                counters = [c[live] for c in counters]
                if not len(at):
                    break
    return at, open_


def links_in_blocks(prints: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (row, lowest row reachable within its block) of consecutive blocks of fingerprints.

    The planes hold bit b of 64 fingerprints in one word, each block from a word of its own. Only the
    pairs of a spanning star leave a block.
    """
    start = np.cumsum(sizes) - sizes
    words = -(-sizes // 64)
    first = np.cumsum(words) - words
    place = np.arange(len(prints)) - np.repeat(start, sizes)
    lane = np.repeat(first * 64, sizes) + place
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    spread = np.zeros((BITS + 1, int(words.sum()) * 64), np.uint8)
    spread[:BITS, lane] = bits.T
    spread[BITS, lane] = 1
    planes = np.packbits(spread, axis=1, bitorder="little").view(np.uint64)
    block = np.repeat(np.arange(len(sizes)), words)
    base = (np.arange(len(block)) - first[block]) * 64
    label = np.arange(len(prints))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    k = 0
    while k < sizes.max() - 1:
        word = np.flatnonzero(sizes[block] > k + 1)
        turns = np.arange(k, k + max(1, _LANES // len(word)))
        turn, entry = (x.ravel() for x in np.broadcast_arrays(turns[:, None], word[None, :]))
        use = turn < sizes[block[entry]] - 1
        turn, entry = turn[use], entry[use]
        shift = np.clip(turn + 1 - base[entry], 0, 64).astype(np.uint64)  # lanes up to the query's own are shut
        open_ = np.where(shift < 64, planes[BITS][entry] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (shift & np.uint64(63))), np.uint64(0))
        use = open_ != 0
        turn, entry, open_ = turn[use], entry[use], open_[use]
        row = start[block[entry]] + turn
        at, near = _within(planes, entry, prints[row], open_, radius)
        if len(at):
            hit = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, bit = np.nonzero(hit)
            source = at[which]
            pairs.append((row[source], start[block[entry[source]]] + base[entry[source]] + bit))
        k = int(turns[-1]) + 1
    if not pairs:
        return label[:0], label[:0]
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while True:
        before = label.copy()
        np.minimum.at(label, b, label[a])
        np.minimum.at(label, a, label[b])
        label = label[label]
        if (label == before).all():
            break
    row = np.flatnonzero(label != np.arange(len(label)))
    return row, label[row]


def _compare(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])], axis=1)
            if held.shape[1] >= _BATCH:
                new = np.flatnonzero((held[:2, 1:] != held[:2, :-1]).any(axis=0)) + 1
                if len(new):  # the last block may go on in the next batch
                    yield from done(held[:, : new[-1]])
                    held = held[:, new[-1] :]
        if held.shape[1]:
            yield from done(held)

    def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.concatenate([[0], np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1, [rows.shape[1]]])
        sizes = np.diff(cuts)
        many = sizes > 1
        if many.any():
            prints = rows[2][np.repeat(many, sizes)].view(np.uint64).copy()
            blocks = sizes[many]
            ends = np.cumsum(blocks)
            at = 0
            while at < len(blocks):  # some blocks at a time
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BATCH, "right")))
                own = prints[(ends[at - 1] if at else 0) : ends[to - 1]]
                row, root = links_in_blocks(own, blocks[at:to], radius)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(own[row].view(np.int64)), pa.array(own[root].view(np.int64))], schema=schema)
                at = to

    return run


def _parts(mask: int, radius: int) -> list[int]:
    """Masks that add two of radius + 2 parts of the free bits: of r + 2 parts, r differences leave two equal."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = np.array_split(free, radius + 2)
    masks = [mask | sum(1 << int(b) for x in pair for b in x) for pair in combinations(cuts, 2)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def near_links(prints: DataFrame, radius: int = 4, block: int = 1024) -> DataFrame:
    """Links (``a``, ``b``) that connect all distinct fingerprints (``print``) within ``radius`` bits of each other.

    Fingerprints meet where two of radius + 2 parts are equal. A meeting place with more than ``block``
    fingerprints is cut anew by the bits that are still free, until it fits or so few bits are free that it
    must: no place is compared whole, skipped or capped. Within a place the comparison is bit-sliced and
    only a spanning star of each group is written.
    """
    spark = prints.sparkSession
    keyed = prints.select("print", F.explode(F.array(*[F.lit(m).cast("long") for m in _parts(0, radius)])).alias("mask"))
    found = []
    while True:
        keyed = keyed.select("mask", F.col("print").bitwiseAND(F.col("mask")).alias("value"), "print")
        # one row per crowded place; masks are few: 15 at first, 15 times as many a level
        crowded = cut_lineage(keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > block))
        masks = [r["mask"] for r in crowded.select("mask").distinct().collect()]
        deeper = [m for m in masks if (BITS - (m & (1 << BITS) - 1).bit_count()) > block.bit_length() - 1]
        fits = keyed
        if deeper:
            again = crowded.where(F.col("mask").isin(deeper)).select("mask", "value")
            fits = keyed.join(again, ["mask", "value"], "left_anti")
        found.append(
            fits.repartition("mask", "value").sortWithinPartitions("mask", "value", "print")
            .mapInArrow(_compare(radius), "a long, b long")
        )
        if not deeper:
            break
        finer = spark.createDataFrame([(m, _parts(m & (1 << BITS) - 1, radius)) for m in deeper], "mask long, finer array<long>")
        keyed = keyed.join(again, ["mask", "value"]).join(finer, "mask").select("print", F.explode("finer").alias("mask")).distinct()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def near_copies(articles: DataFrame, key: str = "URL", text: str = "要約", radius: int = 4, block: int = 1024) -> DataFrame:
    """Fingerprint of each article and the smallest key among those it is linked with.

    Works on the articles of the feeds (``URL``, ``要約``) or on any table with an id and a text. A fingerprint bit is
    set when over half of the hashes of the word shingles (four words, A-Z lower-cased, repeats included) have it;
    texts of fewer words are one shingle. Articles whose fingerprints differ in at most ``radius`` bits are linked,
    and ``component_id`` is the smallest key reachable over links.

    Equal fingerprints are one point, so thousands of copies cost one comparison. A null or empty text has
    fingerprint zero, which is linked like any other; null keys are never the smallest; repeated rows come back as
    often as they came. An empty table gives an empty result.
    """
    rows = narrow(articles, id=key, text=text)
    marked = cut_lineage(rows.select("id", _fingerprints(filled("text").cast("binary")).alias("print")))
    points = cut_lineage(marked.groupBy("print").agg(F.min("id").alias("least")))
    links = cut_lineage(near_links(points.select("print"), radius, block))
    both = cut_lineage(links.union(links.select("b", "a")))
    nodes = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("label"))
    groups = connected_components(nodes, both)
    joined = groups.join(points, groups["node"] == points["print"]).select("node", "label", "least")
    smallest = joined.groupBy("label").agg(F.min("least").alias("smallest"))
    homes = joined.join(smallest, "label").select(F.col("node").alias("print"), "smallest")
    # stored, so that the join reads two plain exchanges and a crowded fingerprint's partition can be split
    homes = cut_lineage(points.join(homes, "print", "left").select("print", F.coalesce("smallest", "least").alias("component_id")))
    return marked.join(homes, "print").select(
        F.col("id").alias(key), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def without_near_copies(articles: DataFrame, key: str = "URL", text: str = "要約", radius: int = 4) -> DataFrame:
    """The articles, all columns, of which one stays for each group of near copies: the one with the smallest key.

    Rows with equal keys are one article, one of them stays; rows without a key can't be told apart and all stay.
    """
    homes = near_copies(articles, key, text, radius).where(F.col(key) == F.col("component_id"))
    homes = homes.select(F.col(key).alias("_keep")).distinct()
    named = articles.join(homes, articles[f"`{key}`"] == homes["_keep"], "left_semi").dropDuplicates([key])
    return named.union(articles.where(articles[f"`{key}`"].isNull()))
