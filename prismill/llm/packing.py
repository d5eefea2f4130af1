"""Pack the token sequences of articles into training sequences by bounded-space online best fit."""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismill.llm.common import filled, narrow
from prismill.session import cut_lineage

PART = 200_000  # pieces one task packs
_LEVEL_BIT, _TASK_BIT = 56, 36  # a bin's name: level, task, number in the task
_MEMO = 400_000  # words whose ids a task remembers


class WordIds(dict):
    """Token ids of whole texts, as little-endian 32-bit bytes.

    The byte-pair vocabulary splits at a space between two other characters whatever stands around, so
    ids of such words are kept and joined; a text with other runs of white space is cut at those
    spaces only. ``ranks`` and ``vocabulary`` are the same public vocabulary in the forms of two libraries.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex
        import tiktoken

        super().__init__()
        with open(vocabulary, encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._clean = regex.compile(r"(?<=\S) (?=\S)")
        self._rare = re.compile(r"[^\S \n]")

    def _bytes(self, text: str) -> bytes:
        ids = self._coder.encode(text, allowed_special="all") if "<|" in text else self._coder.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        # a space or a line break between two other characters is a boundary; beside other white space it is not
        beside = "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] == " " or text[-1] == " " or self._rare.search(text)
        words = self._clean.split(text) if beside else text.replace("\n", " \n").split(" ")
        return self._bytes(words[0]) + b"".join(map(self.__getitem__, words[1:]))

    def __missing__(self, word: str) -> bytes:
        # what follows a line break has no space before it
        ids = self._bytes(word if word.startswith("\n") else " " + word)
        if len(self) >= _MEMO:
            self.clear()
        self[word] = ids
        return ids


@lru_cache(maxsize=1)
def word_ids(vocabulary: str) -> WordIds:
    """One coder per worker process, shared by its tasks."""
    return WordIds(vocabulary)


def _cut(vocabulary: str, length: int, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(vocabulary)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows, piece, start, size, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = ids_of(text.as_py()) + tail
                n = len(ids) // 4
                at, k = 0, 0
                to = n % length or min(n, length)  # a long text's first piece takes what full pieces leave
                while at < n:
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    size.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at, to, k = to, to + length, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, size, crc)]],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    return run


class OpenBins:
    """At most ``limit`` open bins, found by a bitset of their free space."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.count = capacity, limit, 0
        self.free = 0  # bit f: some open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.next = 0

    def place(self, size: int) -> tuple[int, int]:
        """The bin with the least room that is enough, else a new one; the fullest closes when too many are open."""
        fit = self.free >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            name = self.bins[room].pop()
            if not self.bins[room]:
                self.free ^= 1 << room
            self.count -= 1
        else:
            if self.count >= self.limit:
                least = (self.free & -self.free).bit_length() - 1
                self.bins[least].pop()
                if not self.bins[least]:
                    self.free ^= 1 << least
                self.count -= 1
            name, room = self.next, self.capacity
            self.next += 1
        left = room - size
        if left:
            self.bins[left].append(name)
            self.free |= 1 << left
            self.count += 1
        return name, self.capacity - room

    def left(self) -> list[tuple[int, int]]:
        """Open bins and what they hold."""
        return [(name, self.capacity - room) for room, names in enumerate(self.bins) for name in names]


def _pack(size: str, capacity: int, limit: int, level: int) -> Callable:
    """Give each row a bin and an offset; bins still open at the end follow as rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, limit)
        first = (level << _LEVEL_BIT) + (TaskContext.get().partitionId() << _TASK_BIT)
        shape = None
        for batch in batches:
            shape = batch.schema
            placed = [bins.place(n) for n in batch.column(batch.schema.get_field_index(size)).to_pylist()]
            name, offset = zip(*placed) if placed else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([first + x for x in name], pa.int64()), pa.array(offset, pa.int64()), pa.nulls(len(placed), pa.int64())],
                names=[*shape.names, "bin", "offset", "held"],
            )
        left = bins.left()
        if left:
            name, held = zip(*left)
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(len(left), f.type) for f in shape], pa.array([first + x for x in name], pa.int64()), pa.nulls(len(left), pa.int64()), pa.array(held, pa.int64())],
                names=[*shape.names, "bin", "offset", "held"],
            )

    return run


def _packed(rows: DataFrame, size: str, capacity: int, limit: int, level: int, *order: Column) -> DataFrame:
    parts = max(1, -(-rows.count() // PART))
    dealt = rows.repartition(parts, *order) if parts > 1 else rows.repartition(1)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", bin long, offset long, held long"
    return cut_lineage(dealt.sortWithinPartitions(*order).mapInArrow(_pack(size, capacity, limit, level), schema))


def pack_articles(
    articles: DataFrame, vocabulary: str, key: str = "URL", text: str = "要約", length: int = 2048, end: int = 0, open_bins: int = 2048,
) -> DataFrame:
    """Pieces of token sequences and their places in as few sequences of ``length`` tokens as can be.

    Works on the articles of the feeds (``URL``, ``要約``) or on any table with an id and a text. An article is its
    token ids by the public byte-pair ``vocabulary`` (a .json file with the same ranks as .tiktoken beside it;
    special strings in texts are special tokens) and then the id ``end``. Only longer ones are cut: full pieces, before
    them the rest. Each task takes pieces in the order of a hash and puts each into the open sequence with the
    least room that is enough; when ``open_bins`` are open the fullest closes. Sequences still open at the end of
    a task are packed as wholes in the next level, with fewer tasks, until one task has them.

    Returns one row per piece: the key, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``. A null
    or empty text is its end id alone; repeated rows are packed each; null keys stay null. An empty table gives an empty
    result.
    """
    rows = narrow(articles, id=key, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    pieces = cut_lineage(
        rows.select("id", filled("text").alias("text"))
        .mapInArrow(_cut(vocabulary, length, end), f"id {kind}, piece int, start long, length long, ids_crc32 long")
    )
    order = F.xxhash64("id", "piece", "ids_crc32"), F.col("length"), F.col("id"), F.col("piece")
    first = _packed(pieces, "length", length, open_bins, 0, *order)
    placed = first.where("held is null").drop("held")
    left = first.where("held is not null").select(F.col("bin").alias("old"), F.col("held").alias("size"))
    level, n = 0, left.count()
    while n > open_bins:
        level += 1
        again = _packed(left, "size", length, open_bins, level, F.xxhash64("old"), F.col("old"))
        moved = again.where("held is null").select("old", F.col("bin").alias("to"), F.col("offset").alias("shift"))
        placed = placed.join(moved, placed["bin"] == moved["old"], "left").select(
            *pieces.columns, F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
        )
        left = again.where("held is not null").select(F.col("bin").alias("old"), F.col("held").alias("size"))
        before, n = n, left.count()
        if n >= before:
            break
    return placed.select(F.col("id").alias(key), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
