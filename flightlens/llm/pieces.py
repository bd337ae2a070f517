"""A SentencePiece vocabulary as a unigram model: encoding, decoding and counting.

An Aho-Corasick automaton over the pieces reports, at each position of a text, every piece
that ends there (it follows the output links). The Viterbi pass relaxes the best score of
that position from the scores at the pieces' starts, so the text is read once.

Scores are those of the vocabulary file, added exactly (they are whole numbers or short
decimals; no rounding to 32 bits). Of two ways of equal score to reach a position, the one
whose last piece starts earlier wins, as in the library: there a later start must be
strictly better. A character that is no piece costs ``least score - 10`` and becomes its
UTF-8 byte pieces, or the unknown piece if the vocabulary has no byte pieces.

Spaces become ``▁`` (U+2581) and one is put in front, if the vocabulary says so. No piece goes on from another
character to ``▁``, and none holds a line feed, so a text is cut there; short chunks are solved once per process and kept.
Pieces that are user-defined are cut out first and stand for themselves. A literal ``▁`` in a text is written as bytes, so that
decoding gives back every text exactly; if there are no byte pieces it decodes as a space.

The vocabulary is read where an operator is called, and broadcast.

Memory: identifiers and decoded texts take several times the texts, so batches are small; and Spark lets idle Python processes live on
and takes them in turn, so solved chunks are dropped when a task ends.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlens.llm.common import free_name, prepare

SPACE = "▁"
LITERAL = "\ud800"  # stands for a literal "▁"; no text holds a lone surrogate
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNKNOWN_PENALTY = 10
CACHED_CHUNKS, CACHED_CHARS = 300_000, 64
BATCH_BYTES = "2097152"
NEVER = float("-inf")


def default_model() -> str:
    """Path of the public 32,000-piece vocabulary, if it is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def parse(content: bytes) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, type) by identifier, and whether a space is put in front of a text.

    Vocabularies that change characters or white space before they encode are refused: texts would not come back.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(content)
    rules, trained = model.normalizer_spec, model.trainer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or trained.treat_whitespace_as_suffix:
        raise ValueError("the vocabulary normalises texts, or does not mark spaces before words")
    return [(p.piece, p.score, p.type) for p in model.pieces], rules.add_dummy_prefix


class Pieces:
    """Automaton, scores and byte pieces."""

    def __init__(self, vocabulary: list[tuple[str, float, int]], prefix: bool = True):
        self.names = [p for p, _, _ in vocabulary]
        self.scores = scores = [s for _, s, _ in vocabulary]
        self.prefix = SPACE if prefix else ""
        normal = [i for i, (_, _, kind) in enumerate(vocabulary) if kind == NORMAL]
        self.unknown_id = next((i for i, (_, _, kind) in enumerate(vocabulary) if kind == UNKNOWN), 0)
        self.unknown_score = min((scores[i] for i in normal), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = [i for i, (_, _, kind) in enumerate(vocabulary) if kind == BYTE]
        self.singles = {self.names[i] for i in normal if len(self.names[i]) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.names[i], (len(self.names[i]), scores[i], i))
        self.automaton.make_automaton()
        # A cut before "▁" and around "\n" is exact only if no piece goes over it.
        safe = not any(SPACE in self.names[i].lstrip(SPACE) or "\n" in self.names[i] for i in normal)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if safe else "(?s).+").findall
        self.own = {name: i for i, (name, _, kind) in enumerate(vocabulary) if kind == USER_DEFINED}
        names = sorted(self.own, key=len, reverse=True)
        self.apart = re.compile(f"({'|'.join(map(re.escape, names))})").split if names else None
        byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.raw = [byte_of.get(i, name.replace(SPACE, " ").encode()) for i, name in enumerate(self.names)]
        self.forget()

    def forget(self) -> None:
        """Drops the chunks that are kept."""
        self.solved: dict[str, tuple[bytes, bytes]] = {}
        self.sizes: dict[str, tuple[int, float]] = {}

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that are solved by themselves."""
        if not text:
            return []
        if self.byte_ids:
            text = text.replace(SPACE, LITERAL)
        text = self.prefix + text.replace(" ", SPACE)
        if self.apart is None:
            return self.cut(text)
        return [x for k, part in enumerate(self.apart(text)) for x in ([part] if k % 2 else self.cut(part))]

    def unknown(self, chunk: str) -> list[int]:
        """Ends of the characters that are no piece."""
        return [] if self.singles.issuperset(chunk) else [e for e, c in enumerate(chunk, 1) if c not in self.singles]

    @staticmethod
    def surface(char: str) -> str:
        return SPACE if char == LITERAL else char

    def solve(self, chunk: str) -> list[int]:
        """Identifiers of the best segmentation of a chunk."""
        if chunk in self.own:
            return [self.own[chunk]]
        n, odd = len(chunk), self.unknown(chunk)
        best, last, k = [0.0] + [NEVER] * n, [None] * (n + 1), 0  # last: (length, score, identifier) of the last piece
        for at, piece in self.automaton.iter(chunk):
            end = at + 1
            while k < len(odd) and odd[k] < end:
                best[odd[k]], last[odd[k]] = self.spelled(best, last, odd[k])
                k += 1
            reached = best[end - piece[0]] + piece[1]
            if reached > best[end]:
                best[end], last[end] = reached, piece
        for end in odd[k:]:
            best[end], last[end] = self.spelled(best, last, end)
        out, end = [], n
        while end:
            size, _, i = last[end]
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(self.surface(chunk[end - 1]).encode()))
            else:
                out.append(self.unknown_id)
            end -= size
        return out[::-1]

    def spelled(self, best, last, end):
        reached = best[end - 1] + self.unknown_score
        return (reached, (1, 0.0, -1)) if reached > best[end] else (best[end], last[end])

    def measure(self, chunk: str) -> tuple[int, float]:
        """Piece count and score of the best segmentation of a chunk. Nothing else is carried along."""
        if chunk in self.own:
            return 1, 0.0
        n, odd = len(chunk), self.unknown(chunk)
        best, count, k = [0.0] + [NEVER] * n, [0] * (n + 1), 0
        for at, (size, score, _) in self.automaton.iter(chunk):
            end = at + 1
            while k < len(odd) and odd[k] < end:
                best[odd[k]], count[odd[k]] = self.bytes_counted(chunk, best, count, odd[k])
                k += 1
            reached = best[end - size] + score
            if reached > best[end]:
                best[end], count[end] = reached, count[end - size] + 1
        for end in odd[k:]:
            best[end], count[end] = self.bytes_counted(chunk, best, count, end)
        return count[n], best[n]

    def bytes_counted(self, chunk, best, count, end):
        reached = best[end - 1] + self.unknown_score
        if reached <= best[end]:
            return best[end], count[end]
        return reached, count[end - 1] + (len(self.surface(chunk[end - 1]).encode()) if self.byte_ids else 1)

    def parts(self, text: str) -> list[tuple[bytes, bytes]]:
        """For each chunk of a text, its identifiers as 32-bit numbers and the bytes they decode to."""
        out, known = [], self.solved
        for chunk in self.chunks(text):
            found = known.get(chunk)
            if found is None:
                ids = self.solve(chunk)
                found = array("i", ids).tobytes(), b"".join([self.raw[i] for i in ids])
                if len(chunk) <= CACHED_CHARS:
                    if len(known) >= CACHED_CHUNKS:
                        known.clear()
                    known[chunk] = found
            out.append(found)
        return out

    def encode(self, text: str) -> np.ndarray:
        """Identifiers of a text, as 32-bit numbers."""
        return np.frombuffer(b"".join([ids for ids, _ in self.parts(text)]), np.int32)

    def round_trip(self, text: str) -> tuple[np.ndarray, str]:
        """Identifiers of a text, and what they decode to."""
        parts = self.parts(text)
        return np.frombuffer(b"".join([ids for ids, _ in parts]), np.int32), self.text_of(b"".join([raw for _, raw in parts]))

    def count(self, text: str) -> tuple[int, float]:
        """Number of pieces and score of the best segmentation, without the pieces."""
        total, score, known = 0, 0.0, self.sizes
        for chunk in self.chunks(text):
            found = known.get(chunk)
            if found is None:
                found = self.measure(chunk)
                if len(chunk) <= CACHED_CHARS:
                    if len(known) >= CACHED_CHUNKS:
                        known.clear()
                    known[chunk] = found
            total += found[0]
            score += found[1]
        return total, score

    def text_of(self, raw: bytes) -> str:
        text = raw.decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def decode(self, ids) -> str:
        """The text of identifiers: bytes are joined, ``▁`` is a space, the one put in front is dropped."""
        return self.text_of(b"".join(map(self.raw.__getitem__, np.asarray(ids).tolist())))


def load(path: str) -> Pieces:
    return Pieces(*parse(read_bytes(path)))


LOADED: dict[str, Pieces] = {}


def shared_pieces(spark: SparkSession, model: str | None):
    """A function that gives the vocabulary to a task: made once per process from broadcast bytes."""
    content = read_bytes(model or default_model())
    parse(content)  # what is not supported is refused here
    key, shared = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

    def pieces() -> Pieces:
        if key not in LOADED:
            LOADED.clear()
            LOADED[key] = Pieces(*parse(shared.value))
        return LOADED[key]

    return pieces


def encode(docs: DataFrame, *, model: str | None = None, column: str = "text", out: str = "piece_ids") -> DataFrame:
    """``docs`` with the piece identifiers of ``column``: null for null, empty for empty.

    One pass without a shuffle. An existing column named ``out`` keeps its name and the new one
    is numbered. Long texts are solved chunk by chunk; a chunk (up to a space or line feed) takes lists of its length.
    Equal rows get equal identifiers; an empty table gives an empty result.
    """
    prepare(docs.sparkSession, BATCH_BYTES)
    pieces = shared_pieces(docs.sparkSession, model)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pieces()
        for texts in batches:
            yield texts.map(own.encode, na_action="ignore")
        own.forget()

    # Not folded into a function that decodes its result, which would encode twice.
    return docs.withColumn(free_name(docs, out), run.asNondeterministic()(F.col(f"`{column}`")))


def decode(docs: DataFrame, *, model: str | None = None, column: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the identifiers in ``column``: null for null, empty for empty."""
    prepare(docs.sparkSession, BATCH_BYTES)
    pieces = shared_pieces(docs.sparkSession, model)

    @F.pandas_udf(T.StringType())
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(pieces().decode, na_action="ignore")

    return docs.withColumn(free_name(docs, out), run(F.col(f"`{column}`")))


def added(docs: DataFrame, made, names: tuple[str, str]) -> DataFrame:
    """``docs`` with the two fields of the struct column ``made``, under free names."""
    both = free_name(docs, "both")
    fields = made.alias(both)
    out = docs.select("*", fields)
    first, second = (free_name(docs, x) for x in names)
    return out.withColumns({first: F.col(both)["a"], second: F.col(both)["b"]}).drop(both)


def round_trip(docs: DataFrame, *, model: str | None = None, column: str = "text", out: tuple[str, str] = ("piece_ids", "decoded")) -> DataFrame:
    """``docs`` with the identifiers of ``column`` and the text these decode to, from one pass: each different short chunk is encoded and
    decoded once per process. Nulls, empty texts, names and empty tables as in ``encode``."""
    prepare(docs.sparkSession, BATCH_BYTES)
    pieces = shared_pieces(docs.sparkSession, model)

    @F.pandas_udf(T.StructType().add("a", T.ArrayType(T.IntegerType())).add("b", "string"))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = pieces()
        for texts in batches:
            yield pd.DataFrame([own.round_trip(x) if x is not None else (None, None) for x in texts], columns=["a", "b"])
        own.forget()

    return added(docs, run(F.col(f"`{column}`")), out)


def count_tokens(docs: DataFrame, *, model: str | None = None, column: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``token_score``: 0 and 0.0 for empty, null for null texts.

    The Viterbi pass carries only the best score and its piece count; byte pieces count one
    each. No shuffle. Existing columns keep their names and the new ones are numbered. Equal rows get equal counts; an
    empty table gives an empty result.
    """
    prepare(docs.sparkSession, BATCH_BYTES)
    pieces = shared_pieces(docs.sparkSession, model)

    @F.pandas_udf(T.StructType().add("a", "long").add("b", "double"))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = pieces()
        for texts in batches:
            found = [own.count(x) if x is not None else (None, None) for x in texts]
            yield pd.DataFrame({"a": pd.array([n for n, _ in found], "Int64"), "b": [s for _, s in found]})
        own.forget()

    return added(docs, run(F.col(f"`{column}`")), ("n_tokens", "token_score"))
