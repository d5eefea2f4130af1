"""Count the tokens of whole articles with a tokenizer compiled to finite-state counting machines."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismill.llm.common import filled, narrow

CHUNK = 1 << 16  # code points one chunk has
_MEMO = 400_000  # words whose counts a task remembers
_PAIRS = 1_000_000  # token pairs whose arcs a task remembers

# The white space, the special strings and the split pattern of the vocabulary file.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: between these no token reaches across, in whatever state the machine is
_CUT = regex.compile(r"[ \n\t\r]")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free one above 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class WordMachine:
    """Counts the tokens of a word as a transducer that reads it from left to right.

    The state at a place is the last token of what is read so far. An arc leads from the state at an
    earlier place over a token that ends here, and adds one to the count. It exists where the merges
    leave the two tokens apart, so exactly one arc enters each place and the machine is
    deterministic. Arcs are compiled on first use.
    """

    def __init__(self, merges: list[list[str]], tokens: set[str], end: str):
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.tokens, self.end = tokens, end
        self.reach = max(len(t.removesuffix(end)) for t in tokens)
        self.arcs: dict[tuple[str, str], bool] = {}

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 30))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def arc(self, state: str, token: str) -> bool:
        """Whether ``token`` may follow ``state`` ("" at a word's start)."""
        known = self.arcs.get((state, token))
        if known is None:
            if len(self.arcs) >= _PAIRS:
                self.arcs.clear()
            parts = [state, token] if state else [token]
            known = self._merged([s for p in parts for s in self._symbols(p)]) == parts
            self.arcs[state, token] = known
        return known

    def count(self, word: str) -> int:
        """Tokens of a word of byte letters."""
        states, counts, tokens, known = [""], [0], self.tokens, self.arcs
        n, reach = len(word), self.reach
        for i in range(1, n + 1):
            read = word if i < n else word + self.end
            to = i if i < n else None
            for start in range(i - reach if i > reach else 0, i):
                token = read[start:to]
                if token in tokens:
                    state = states[start]
                    fits = known.get((state, token))
                    if fits or (fits is None and self.arc(state, token)):
                        states.append(token)
                        counts.append(counts[start] + 1)
                        break
            else:
                raise ValueError(f"the vocabulary has no tokens for {word!r}")
        return counts[n]


class Fragments(dict):
    """Token counts of text fragments, compiled on first use and kept up to a bound."""

    def __init__(self, vocabulary: str):
        super().__init__()
        with open(vocabulary, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.words = WordMachine(merges, set(model["vocab"]), model["end_of_word_suffix"] or "")
        self.special = regex.compile("(" + "|".join(regex.escape(t["content"]) for t in whole["added_tokens"]) + ")")
        self.letters = _byte_letters()
        self.known: dict[str, int] = {}

    def __missing__(self, fragment: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        total = 0
        for i, part in enumerate(self.special.split(fragment)):
            if i % 2:
                total += 1
                continue
            part = unicodedata.normalize("NFC", part)
            part = part.replace("Σ", "σ").lower()  # letter by letter: a final sigma is no other letter
            for word in _SPLIT.findall(part):
                n = self.known.get(word)
                if n is None:
                    if len(self.known) >= _MEMO:
                        self.known.clear()
                    n = self.known[word] = self.words.count("".join(map(self.letters.__getitem__, word.encode())))
                total += n
        self[fragment] = total
        return total


@lru_cache(maxsize=1)
def fragments_of(vocabulary: str) -> Fragments:
    """One compiled machine per worker process, shared by its tasks."""
    return Fragments(vocabulary)


# --- chunks -------------------------------------------------------------------------

#: What a chunk does to the machine from any state: text that goes on an earlier word, tokens of all whole words,
#: text that is still open. Without a cut inside, the chunk is open as a whole and ``head`` is null.
Map = tuple[str | None, int, str]


def chunk_map(chunk: str, fragments: Fragments) -> Map:
    first = _CUT.search(chunk)
    if first is None:
        return None, 0, chunk
    words = chunk.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    return words[0], sum(map(fragments.__getitem__, words[1:-1])), words[-1]


def compose(left: Map, right: Map, fragments: Fragments) -> Map:
    """The map of two neighbours; associative, so any tree over the chunks gives the same."""
    if right[0] is None:
        return left[0], left[1], left[2] + right[2]
    if left[0] is None:
        return left[2] + right[0], right[1], right[2]
    return left[0], left[1] + right[1] + fragments[left[2] + right[0]], right[2]


def scan(maps: list[Map], fragments: Fragments) -> int:
    """Tokens of the chunks in order, by rounds of pairs."""
    while len(maps) > 1:
        pairs = [compose(a, b, fragments) for a, b in zip(maps[::2], maps[1::2])]
        maps = pairs + maps[len(pairs) * 2 :]
    head, n, tail = maps[0]
    return (fragments[head] if head is not None else 0) + n + fragments[tail]


_SUMMARY = "struct<head: string, n: bigint, tail: string>"


def _summaries(vocabulary: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragments = fragments_of(vocabulary)
        for batch in batches:
            maps = []
            for alone, chunk in zip(batch.column(4).to_pylist(), batch.column(5)):
                made = chunk_map(chunk.as_py(), fragments)
                maps.append((None, scan([made], fragments), "") if alone else made)
            head, n, tail = zip(*maps) if maps else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(head, pa.string()), pa.array(n, pa.int64()), pa.array(tail, pa.string())],
                names=["row", "id", "n_bytes", "place", "head", "n", "tail"],
            )

    return run


def _totals(vocabulary: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragments = fragments_of(vocabulary)
        for batch in batches:
            totals = [scan([(m["head"], m["n"], m["tail"]) for m in maps.as_py()], fragments) for maps in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(totals, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(articles: DataFrame, vocabulary: str, key: str = "URL", text: str = "要約", limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """Bytes and tokens of every article's whole text.

    Works on the articles of the feeds (``URL``, ``要約``) or on any table with an id and a text. ``vocabulary`` is the
    .json file of a byte-pair tokenizer whose words end in a suffix; begin and end tokens are not counted, special
    strings inside a text are one token each. Texts are cut into chunks of ``chunk`` code points, each becomes its state
    map (what it adds, and what it leaves open at both ends) wherever a task has room, and the maps of
    an article are composed pair by pair. Texts of one chunk, nearly all, are done where they are read.

    Returns one row per article: the key, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).
    Null and empty texts have none; repeated rows are counted each; null keys stay null. An empty table
    gives an empty result.
    """
    rows = narrow(articles, id=key, text=text).select("id", filled("text").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    length = F.length("text")
    short = F.array(F.struct(F.lit(0).alias("place"), F.lit(True).alias("alone"), F.col("text").alias("chunk")))
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((length - 1) / chunk)).cast("int")),
        lambda i: F.struct(i.alias("place"), F.lit(False).alias("alone"), F.substring("text", i * chunk + 1, F.lit(chunk)).alias("chunk")),
    )
    # numbered before they are cut: the chunks of a row share its number
    pieces = rows.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.inline(F.when(length <= chunk, short).otherwise(cut))
    )
    maps = pieces.mapInArrow(
        _summaries(vocabulary), f"row long, id {kind}, n_bytes long, place int, head string, n long, tail string"
    )
    alone = F.col("head").isNull() & (F.col("tail") == "")
    maps = maps.groupBy("row").agg(
        F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"),
        F.sort_array(F.collect_list(F.when(~alone, F.struct("place", "head", "n", "tail")))).alias("maps"), F.sum("n").alias("n"),
    )
    maps = maps.select("id", "n_bytes", F.when(F.size("maps") > 0, F.col("maps")).otherwise(F.array(F.struct(
        F.lit(0).alias("place"), F.lit(None).cast("string").alias("head"), F.col("n"), F.lit("").alias("tail")))).alias("maps"))
    counted = maps.mapInArrow(_totals(vocabulary), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
