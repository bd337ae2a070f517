"""Language-model scores by marginalising over subword segmentations.

The model is a unigram model over the pieces of an existing vocabulary. The probability of a
word is the sum over all its segmentations into pieces, by a forward recursion in log space;
a text's is the product over its words and one end symbol.

Piece weights: the vocabulary's order gives a start, weight 1 / (rank + 1) by falling score.
One pass of expectation-maximisation over the training words, weighted by their counts,
turns it into expected counts; each piece gets one more, so none is impossible. Characters
outside the vocabulary are spelled by their byte pieces.

Words are counted over all documents: each task counts its own first. A word that makes up more than ``1 / max_hot`` of
all tokens is *hot*: there are fewer than ``max_hot`` such words, so they are broadcast, and their
tokens are summed by document where the texts are read. Other tokens are joined by word; none of these words is frequent.

The forward recursion takes many words at a time: one pass of an Aho-Corasick automaton over all of them gives the
arcs of their lattices, and the arcs that end at the same place of their words are summed together.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.llm.common import did, prepare, sig
from flightlens.llm.pieces import BYTE, LITERAL, NORMAL, SPACE, UNKNOWN, default_model, parse, read_bytes
from flightlens.session import materialize

MAX_HOT = 200_000
COUNTED = 300_000  # different words a task counts before it hands the counts on
CHARS_AT_ONCE = 100_000
BETWEEN = "\ud801"  # between words; no piece holds a lone surrogate
NEVER = float("-inf")
SCHEMA_COUNTS = "piece int, n double"
SCHEMA_SUMS = "did bigint, sig bigint, held_out boolean, docs bigint, word binary, tokens bigint, known bigint, base double, lp double"


def start_weights(vocabulary) -> list[float]:
    """Log weights by identifier: 1 / (rank + 1), ranked by falling score; byte pieces and the end come last."""
    usable = [i for i, (_, _, kind) in enumerate(vocabulary) if kind in (1, 6)]
    usable.sort(key=lambda i: (vocabulary[i][2] != 1, -vocabulary[i][1], i))
    weights = [1.0 / (rank + 1) for rank in range(len(usable))]
    total, out = sum(weights), [float("-inf")] * len(vocabulary)
    for i, w in zip(usable, weights, strict=True):
        out[i] = math.log(w / total)
    return out


class Lattice:
    """All segmentations of words under given log weights by identifier."""

    def __init__(self, vocabulary, weights):
        self.weights = np.asarray(weights, np.float64)
        self.size = np.array([len(p) for p, _, _ in vocabulary])
        normal = [i for i, (_, _, kind) in enumerate(vocabulary) if kind == NORMAL]
        self.singles = {vocabulary[i][0] for i in normal if len(vocabulary[i][0]) == 1} | {BETWEEN}
        self.byte_ids = [i for i, (_, _, kind) in enumerate(vocabulary) if kind == BYTE]
        self.unknown_id = next((i for i, (_, _, kind) in enumerate(vocabulary) if kind == UNKNOWN), 0)
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(vocabulary[i][0], i)
        self.automaton.make_automaton()

    def spelling(self, char: str) -> list[int]:
        """Identifiers of a character that is no piece."""
        return [self.byte_ids[b] for b in (SPACE if char == LITERAL else char).encode()] if self.byte_ids else [self.unknown_id]

    def arcs(self, words: list[str]):
        """``first`` and ``last`` node of each word, and for every arc its ends, its log weight and its identifier, or -1 - k for the k-th of ``spelled``.

        Each word has a node before, between and after its characters, with a space in front.
        """
        text = BETWEEN.join([SPACE + w.replace(SPACE, LITERAL) for w in words])
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        end, ids = found[:, 0] + 1, found[:, 1]
        start, weight = end - self.size[ids], self.weights[ids]
        spelled = []
        odd = set(text) - self.singles
        if odd:
            spelling = {c: self.spelling(c) for c in odd}
            at = [k for k, c in enumerate(text) if c in odd]
            spelled = [spelling[text[k]] for k in at]
            cost = {c: self.weights[x].sum() for c, x in spelling.items()}
            start, end = np.append(start, at), np.append(end, np.array(at) + 1)
            weight, ids = np.append(weight, [cost[text[k]] for k in at]), np.append(ids, -1 - np.arange(len(at)))
        last = np.cumsum([len(w) + 2 for w in words]) - 1
        return np.append(0, last[:-1] + 1), last, start, end, weight, ids, spelled

    def sums(self, first: np.ndarray, last: np.ndarray, begin: np.ndarray, into: np.ndarray, weight: np.ndarray, forward: bool) -> np.ndarray:
        """For each node, the log of the sum over the ways to it from its word's first (or to its last) node, of arcs ``begin`` → ``into``."""
        out = np.full(last[-1] + 1, NEVER)
        out[first if forward else last] = 0.0
        length = last - first + 1
        step = np.arange(last[-1] + 1) - np.repeat(first, length)
        if not forward:
            step = np.repeat(length - 1, length) - step
        order = np.lexsort((into, step[into]))
        begin, into, weight, step = begin[order], into[order], weight[order], step[into[order]]
        levels = np.append(np.flatnonzero(np.append(True, step[1:] != step[:-1])), len(step)) if len(step) else [0]
        nodes = np.flatnonzero(np.append(True, into[1:] != into[:-1]))  # the first arc of each node
        for low, high in zip(levels[:-1], levels[1:], strict=True):
            value = out[begin[low:high]] + weight[low:high]
            group = nodes[np.searchsorted(nodes, low) : np.searchsorted(nodes, high)]
            most = np.maximum.reduceat(value, group - low)
            most[most == NEVER] = 0.0
            total = np.add.reduceat(np.exp(value - np.repeat(most, np.diff(np.append(group, high)))), group - low)
            with np.errstate(divide="ignore"):
                out[into[group]] = np.log(total) + most
        return out

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        first, last, start, end, weight, _, _ = self.arcs(words)
        return self.sums(first, last, start, end, weight, True)[last]

    def expected(self, words: list[str], times: np.ndarray, into: np.ndarray) -> None:
        """Adds the expected count of each piece in each word, as often as ``times`` says."""
        if not words:
            return
        first, last, start, end, weight, ids, spelled = self.arcs(words)
        alpha, beta = self.sums(first, last, start, end, weight, True), self.sums(first, last, end, start, weight, False)
        word = np.searchsorted(last, end)
        share = np.exp(alpha[start] + weight + beta[end] - alpha[last][word]) * times[word]
        known = ids >= 0
        into += np.bincount(ids[known], share[known], len(into))
        for k, x in zip((-1 - ids[~known]).tolist(), share[~known].tolist(), strict=True):
            np.add.at(into, spelled[k], x)


def in_parts(words: list[str]):
    """Bounds of runs of words of about ``CHARS_AT_ONCE``; a longer word is a run of its own."""
    begin, size = 0, 0
    for k, word in enumerate(words):
        if size and size + len(word) > CHARS_AT_ONCE:
            yield begin, k
            begin, size = k, 0
        size += len(word)
    if begin < len(words):
        yield begin, len(words)


def words_in(batch: pa.RecordBatch) -> list[str]:
    return batch.column(0).cast(pa.string()).to_pylist()


def expect(vocabulary, weights):
    """(word, n) → expected piece counts of this task, at most one row per piece."""

    def run(batches):
        lattice = Lattice(vocabulary.value, weights)
        into = np.zeros(len(lattice.weights))
        for batch in batches:
            words, times = words_in(batch), batch.column(1).to_numpy()
            for a, b in in_parts(words):
                lattice.expected(words[a:b], times[a:b], into)
        (at,) = into.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(into[at])], names=["piece", "n"])

    return run


def score_words(vocabulary, weights):
    """Adds ``lp``, the log10 probability of each word, to (word, ...)."""

    def run(batches):
        lattice = Lattice(vocabulary.value, weights)
        for batch in batches:
            words = words_in(batch)
            lp = [lattice.log_probabilities(words[a:b]) / math.log(10) for a, b in in_parts(words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(lp) if lp else [], pa.float64())], names=[*batch.schema.names, "lp"])

    return run


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: of bytes, these are ``lower`` and ``split``."""
    return text.lower().split() if text else []


def count_words(batches):
    """(held_out, text) → (word, c, all): counts of a task, c without the held-out texts."""
    train, held = Counter(), Counter()

    def flush():
        words = list(train.keys() | held.keys())
        c = np.fromiter((train[w] for w in words), np.int64, len(words))
        both = c + np.fromiter((held[w] for w in words), np.int64, len(words))
        for k in range(0, len(words), 50_000):
            part = slice(k, k + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(words[part], pa.binary()), pa.array(c[part]), pa.array(both[part])], names=["word", "c", "all"])
        train.clear()
        held.clear()

    for batch in batches:
        for out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (held if out else train).update(tokens_of(text))
            if len(train) + len(held) >= COUNTED:
                yield from flush()
    yield from flush()


def sum_tokens(hot):
    """(did, sig, held_out, text) → ``SCHEMA_SUMS``: a row with the sums of each text's hot tokens, and one for each of its other words.

    ``word`` of the first kind is the text's own name with a space, which is no word.
    """

    def run(batches):
        words, known, base, lp = hot.value
        place = {w: k for k, w in enumerate(words)}.get
        for batch in batches:
            rows = []
            for d, s, out, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                tokens = tokens_of(text)
                at = [place(w) for w in tokens]
                near = np.array([k for k in at if k is not None], np.int64)
                rows.append((d, s, out, 1, b" %d %d" % (d, s), len(near), int(known[near].sum()), float(base[near].sum()), float(lp[near].sum())))
                if len(near) < len(tokens):
                    rows += [(d, s, out, 0, w, n, None, None, None) for w, n in Counter(w for w, k in zip(tokens, at, strict=True) if k is None).items()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            names = [x.split()[0] for x in SCHEMA_SUMS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, *, model: str | None = None, max_hot: int = MAX_HOT) -> DataFrame:
    """did, sig, held_out, copies, n_tokens, n_known, train_tokens, base_score and score of each
    different row.

    Tokens are the words of the lower-cased (A-Z) text and one end; a null or empty text has
    the end only. A null ``doc_id`` is in the training part. Without training documents the
    pieces keep one count each. Equal rows are scored once (``copies`` says how many there are) but counted in training each time.
    An empty table gives an empty result. Other columns do not matter, whatever their names. A text is one value; a word takes
    memory in proportion to its length, a million characters about 300 MB.
    """
    spark = docs.sparkSession
    prepare(spark)
    vocabulary, _ = parse(read_bytes(model or default_model()))
    shared = spark.sparkContext.broadcast(vocabulary)
    raw = F.col("text").cast("binary").alias("text")
    rows = docs.select(did().alias("did"), sig().alias("sig"), held_out().alias("held_out"), raw)
    words = rows.select("held_out", "text").mapInArrow(count_words, "word binary, c bigint, `all` bigint")
    words = materialize(words.groupBy("word").agg(F.sum("c").alias("c"), F.sum("all").alias("all")), "words")

    ends = docs.select(F.count_if(~held_out()).alias("n")).first().n
    seen = words.agg(F.sum("c").alias("c"), F.sum("all").alias("all"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = (seen.c or 0) + ends, (seen.v or 0) + (ends > 0)
    expected = words.where("c > 0").select("word", F.col("c").cast("double")).mapInArrow(expect(shared, start_weights(vocabulary)), SCHEMA_COUNTS)
    counts = np.array([float(kind in (NORMAL, BYTE)) for _, _, kind in vocabulary])
    for row in expected.groupBy("piece").agg(F.sum("n").alias("n")).collect():  # as long as the vocabulary
        counts[row.piece] += row.n
    total = counts.sum() + ends + 1
    weights = np.log(counts, where=counts > 0, out=np.full(len(counts), -np.inf)) - math.log(total)
    end_lp = math.log10((ends + 1) / total)

    def base(c):
        return F.log10((c + 1) / F.lit(float(n + v + 1)))

    known = words.mapInArrow(score_words(shared, weights), "word binary, c bigint, `all` bigint, lp double")
    known = materialize(known.withColumns({"base": base(F.col("c")), "seen": (F.col("c") > 0).cast("long")}), "scored")
    least = (seen["all"] or 0) / max_hot
    hot = known.where(F.col("all") > least).select("word", "seen", "base", "lp").collect()  # fewer than max_hot
    columns = [np.array([r[k] for r in hot], t) for k, t in ((1, np.int64), (2, np.float64), (3, np.float64))]
    hot = spark.sparkContext.broadcast(([bytes(r.word) for r in hot], *columns))
    cold = known.where(F.col("all") <= least).select("word", F.col("seen").alias("own"), F.col("base").alias("own_base"), F.col("lp").alias("own_lp"))

    parts = rows.mapInArrow(sum_tokens(hot), SCHEMA_SUMS).join(cold, "word", "left")
    sums = {"known": "own", "base": "own_base", "lp": "own_lp"}
    parts = parts.groupBy("did", "sig", "held_out").agg(
        F.sum("docs").alias("copies"), F.sum("tokens").alias("tokens"), *(F.sum(F.coalesce(F.col(c), F.col("tokens") * F.col(o))).alias(c) for c, o in sums.items())
    )
    # Equal rows have been summed together; each has its share.
    got = {c: F.col(c) / F.col("copies") for c in ("tokens", "known", "base", "lp")}
    return parts.select(
        "did",
        "sig",
        "held_out",
        "copies",
        (F.round(got["tokens"]).cast("long") + 1).alias("n_tokens"),
        (F.round(got["known"]).cast("long") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (got["base"] + base(F.lit(float(ends)))).alias("base_score"),
        (got["lp"] + F.lit(end_lp)).alias("score"),
    )
