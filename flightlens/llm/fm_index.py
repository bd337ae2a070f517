"""Benchmark decontamination with an FM-index per shard of the training text.

A shard is a bounded batch of documents. Its words are numbered by the benchmark's words;
every other word is a wall that no phrase can cross, and a stretch between walls that is
shorter than the shortest phrase cannot hold one, so neither is indexed. Over what is left:

* a suffix array by prefix doubling (walls are all different, so equal stretches end there);
* the Burrows-Wheeler transform in a wavelet matrix: a word's rank in a prefix is one
  lookup per bit level;
* positions of every ``SAMPLE``-th word and of the first of each stretch.

All phrases (windows of the benchmark items) are searched backwards together, word by word.
Occurrences are located by steps back to a sampled position, and the spans they cover are
merged by document. The benchmark is cut into parts of bounded size, which are searched one
after the other and put together by document: any size of benchmark will do.
"""

from __future__ import annotations

import functools
import uuid
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlens.llm.common import free_name, prepare, quoted

WINDOW = 13
SAMPLE = 16
SHARD_WORDS = 1_000_000
BATCH_BYTES = "2097152"
PART_CHARS = 2_000_000
# Separators of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z in lower case, as bytes of UTF-8.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes. No symbol pattern may repeat to the end: the last is unique."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, step = len(rank), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Wavelet:
    """Ranks of symbols in prefixes of a sequence, one bit level after another."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            ones = np.concatenate([[0], np.cumsum((sequence >> level) & 1)]).astype(np.int32)
            zeros = len(sequence) - int(ones[-1])
            self.levels.append((level, ones, zeros))
            bit = ((sequence >> level) & 1).astype(bool)
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        start = np.zeros_like(end)
        for level, ones, zeros in self.levels:
            bit = (symbol >> level) & 1 == 1
            start, end = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (start, end))
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and how often each occurs before its place."""
        symbol, start, here = np.zeros_like(at), np.zeros_like(at), at.copy()
        for level, ones, zeros in self.levels:
            bit = ones[here + 1] > ones[here]
            symbol |= bit.astype(at.dtype) << level
            start, here = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (start, here))
        return symbol, here - start


class FMIndex:
    """Over numbers from 1; 0 is a wall. Each stretch is followed by a wall."""

    def __init__(self, text: np.ndarray):
        walls = text == 0
        unique = text.astype(np.int64) + int(walls.sum())
        unique[walls] = np.arange(walls.sum())
        self.order = suffix_array(unique)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        last = text[self.order - 1]  # the word before each suffix; a wall before the first
        self.bwt = Wavelet(last.astype(np.int64), max(int(text.max()).bit_length(), 1))
        sampled = (np.arange(len(text)) % SAMPLE == 0) | walls | np.concatenate([[True], walls[:-1]])
        self.sampled = sampled[self.order]
        self.kept = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = self.order[self.sampled]
        del self.order

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (from, to) of the suffixes that start with each phrase. ``phrases``: padded with 0 behind."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.kept.size - 1)
        known = phrases.max(axis=1, initial=0) < self.first.size - 1
        high[~known] = 0
        for k in range(phrases.shape[1] - 1, -1, -1):
            (now,) = ((lengths > k) & (high > low)).nonzero()
            symbol = phrases[now, k]
            base = self.first[symbol]
            low[now], high[now] = base + self.bwt.rank(symbol, low[now]), base + self.bwt.rank(symbol, high[now])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled one."""
        out, at, steps, here = np.empty(len(rows), np.int64), np.arange(len(rows)), 0, rows.copy()
        while len(here):
            done = self.sampled[here]
            out[at[done]] = self.positions[self.kept[here[done]]] + steps
            here, at, steps = here[~done], at[~done], steps + 1
            symbol, rank = self.bwt.access(here)
            here = self.first[symbol] + rank
        return out


class Phrases:
    """Windows of the items of one part of the benchmark."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for i in range(max(len(ids) - window, 0) + 1 if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(name)
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.matrix = np.zeros((len(found), window), np.int64)
        for row, phrase in enumerate(found):
            self.matrix[row, : len(phrase)] = phrase
        self.items = [sorted(x - {None}) for x in found.values()]
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0


def stretches(ids: np.ndarray, shortest: int) -> np.ndarray:
    """Where words lie in stretches without a wall that are long enough."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]])))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= shortest
    mark = np.zeros(len(ids) + 1, np.int8)
    mark[starts[long]] += 1
    mark[ends[long]] -= 1
    return np.cumsum(mark[:-1]).astype(bool)


def search_shard(ids: np.ndarray, phrases: Phrases):
    """(start, end, phrase) of every occurrence; ``ids`` holds a wall after each document."""
    none = np.zeros(0, np.int64)
    if not phrases.shortest:
        return none, none, none
    inside = stretches(ids, phrases.shortest)
    if not inside.any():
        return none, none, none
    kept = inside | np.concatenate([[False], inside[:-1]])  # each stretch and the wall behind it
    where = np.flatnonzero(kept)
    index = FMIndex(np.where(inside, ids, 0)[where])
    low, high = index.search(phrases.matrix, phrases.lengths)
    count = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(low)), count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    start = where[index.locate(rows)]
    return start, start + phrases.lengths[phrase], phrase


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and adjoining spans as one, in order."""
    spans: list[list[int]] = []
    for s, e in sorted(zip(start.tolist(), end.tolist(), strict=True)):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    return [tuple(x) for x in spans]


@functools.lru_cache(maxsize=2)
def phrases_of(key: str, window: int, items) -> Phrases:
    return Phrases(items.value, window)


class Shared:
    """A broadcast part of the benchmark that is equal only to itself, whatever process it is in."""

    def __init__(self, key: str, broadcast):
        self.key, self.broadcast = key, broadcast

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key

    @property
    def value(self):
        return self.broadcast.value


def search_texts(lists: list[list[bytes]], phrases: Phrases) -> list[tuple[list[int], list[int], list[str]]]:
    """One shard: (first words, last words, items) of the merged spans of each document."""
    sizes = np.array([len(x) + 1 for x in lists])
    ids = np.zeros(sizes.sum(), np.int64)
    starts = np.cumsum(sizes) - sizes
    known = phrases.vocabulary.get
    for first, of in zip(starts, lists, strict=True):
        ids[first : first + len(of)] = list(map(known, of, repeat(0)))
    start, end, phrase = search_shard(ids, phrases)
    document = np.searchsorted(starts, start, side="right") - 1
    order = np.argsort(document, kind="stable")
    bounds = np.searchsorted(document[order], np.arange(len(lists) + 1))
    out = []
    for k in range(len(lists)):
        mine = order[bounds[k] : bounds[k + 1]]
        spans = merged(start[mine] - starts[k], end[mine] - starts[k])
        items = sorted({i for p in set(phrase[mine].tolist()) for i in phrases.items[p]})
        out.append(([a for a, _ in spans], [b - 1 for _, b in spans], items))
    return out


LONGS, STRINGS = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
HITS = T.StructType().add("n_words", "long").add("first", LONGS).add("last", LONGS).add("items", STRINGS)


def hits(text: Column, part: Shared, window: int) -> Column:
    @F.pandas_udf(HITS)
    def run(texts: pd.Series) -> pd.DataFrame:
        phrases = phrases_of(part.key, window, part)
        out, lists, held = [], [], 0
        for k, one in enumerate(texts, 1):
            lists.append(words(one))
            held += len(lists[-1])
            if held >= SHARD_WORDS or k == len(texts):
                out += [(len(x), *found) for x, found in zip(lists, search_texts(lists, phrases), strict=True)]
                lists, held = [], 0
        return pd.DataFrame(out, columns=HITS.names)

    return run(text)


@F.pandas_udf(HITS)
def together(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
    """Hits of the same documents in two parts of the benchmark."""
    out = []
    for n, a, b, x, c, d, y in zip(one["n_words"], one["first"], one["last"], one["items"], two["first"], two["last"], two["items"], strict=True):
        spans = merged(np.concatenate([a, c]).astype(np.int64), np.concatenate([b, d]).astype(np.int64) + 1)
        out.append((n, [s for s, _ in spans], [e - 1 for _, e in spans], sorted({*x, *y})))
    return pd.DataFrame(out, columns=HITS.names)


def parts_of(benchmark: DataFrame, part_chars: int):
    """The benchmark's different rows in parts of about ``part_chars`` characters, one at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.length("text") + 16).alias("n")).first().n or 0
    count = max(-(-total // part_chars), 1)
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) if count > 1 else rows
        yield sorted(((r.item, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1]))


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, part_chars: int = PART_CHARS) -> DataFrame:
    """``docs`` with ``hits``: n_words, spans (first and last word, from 0), items (identifiers as
    text, sorted), n_hit and contaminated. No row moves to another task.

    Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased (A-Z) texts. Phrases: all ``window``
    consecutive words of an item, or the whole item if it has fewer, but not none. A document
    is contaminated if any word is hit and at least one in twenty. Null and empty texts have
    no words. Items without an identifier hit words but are not listed. Without benchmark
    rows nothing is hit; an empty table gives an empty result. An existing column ``hits``
    keeps its name and the new one is numbered.
    """
    spark = docs.sparkSession
    prepare(spark, BATCH_BYTES)
    name = free_name(docs, "hits")
    for k, part in enumerate(parts_of(benchmark, part_chars)):
        shared = Shared(uuid.uuid4().hex, spark.sparkContext.broadcast(part))
        more = hits(F.col("text"), shared, window)
        docs = docs.withColumn(name, more if k == 0 else together(F.col(name), more))
    h = F.col(name)
    spans = F.arrays_zip(h["first"].alias("first"), h["last"].alias("last"))
    n_hit = F.aggregate(F.zip_with(h["first"], h["last"], lambda a, b: b - a + 1), F.lit(0).cast("long"), lambda acc, x: acc + x)
    contaminated = (n_hit > 0) & (20 * n_hit >= h["n_words"])
    return docs.withColumn(name, F.struct(h["n_words"].alias("n_words"), spans.alias("spans"), h["items"].alias("items"), n_hit.alias("n_hit"), contaminated.alias("contaminated")))


def keep(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    found = find(docs, benchmark, **settings)
    return found.where(~F.col(found.columns[-1])["contaminated"]).select(*quoted(docs.columns))
