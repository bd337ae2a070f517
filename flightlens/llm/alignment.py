"""Alignment of two tokenizers over a corpus, counted with inverted bitmaps of documents.

1. Each text is encoded by both tokenizers. Byte offsets where tokens of both end cut it into groups, and the two tokens that end
   there are linked. A document keeps its different pairs of linked tokens with their multiplicities.
2. The lists are inverted. Documents are numbered by their places in the input, 65,536 numbers to a chunk. For each pair and chunk there is a
   compressed bitmap of the documents that have the pair, and further *planes* for multiplicities m: plane k holds the documents with bit k - 1 in m - 1.
   A plane of under 4,096 documents is a sorted list of 16-bit numbers, a fuller one is 8,192 bytes of bits.
3. Parts of a plane that come from different batches are OR-merged, and counted: the first plane's bits are documents, and all
   planes' bits, weighted, are links. Sums over the chunks are the pair's counts; the highest of a token's pairs is its best.
4. The planes are postings: each returns its pair's scores to its documents, chunk by chunk, with one array of sums for a chunk.

A plane has at most 8,192 bytes and a chunk's sums 1 MB, however frequent a pair is. Frequent pairs have a row per chunk, which are
shuffled by pair and chunk, summed in each task first, and meet their counts by broadcast.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.llm.common import prepare
from flightlens.session import materialize

CHUNK = 2**16
DENSE = CHUNK // 16  # from here on a bitmap is shorter than a list of 16-bit numbers
AT_ONCE = 2_000_000  # links inverted at a time
TEXTS_AT_ONCE, BYTES_AT_ONCE = 64, 500_000
MAX_HOT = 1000
ALIGNED = "place bigint, doc_id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<int>"
PLANE = "pair bigint, chunk bigint, plane int, bits binary"


def default_vocabularies() -> tuple[str, str]:
    """Paths of the public byte-level and piece vocabularies, if they are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: itself where Latin-1 prints it, the others from U+0100 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(0x100 + k): b for k, b in enumerate(others)}


# Fixed value: how a byte-level vocabulary of this family cuts a text into words before it merges bytes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_encoder(content: bytes, entries: dict[str, int], spelled: list[bytes]):
    """Text → identifiers of a byte-level vocabulary file; strings of special tokens are plain text.

    Where each merge makes the next identifier, merging by lowest identifier is the file's own algorithm, and a library that does that
    is several times faster than the file's; other files are left to their library.
    """
    spec = json.loads(content)
    model, cutting = spec["model"], spec["pre_tokenizer"] or {}
    merged = [entries["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    plain = not spec["normalizer"] and cutting == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": cutting.get("trim_offsets"), "use_regex": True}
    if plain and merged == list(range(256, 256 + len(merged))):
        import tiktoken

        ranks = {spelled[i]: i for entry, i in model["vocab"].items() if i < 256 + len(merged)}
        return tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class Aligner:
    """Both tokenizers, with the bytes and the written form of every token."""

    def __init__(self, byte_level: bytes, piece_model: bytes):
        from sentencepiece import SentencePieceProcessor

        spec, alphabet = json.loads(byte_level), byte_alphabet()
        entries = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry)
        self.encode_a = byte_level_encoder(byte_level, entries, self.a_bytes)
        self.b = SentencePieceProcessor(model_proto=piece_model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # Every token as written inside its group and at its end: A ",", A "|", B ",", B ";".
        self.written = [f"{i}{mark}" for side, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for mark in marks for i in range(len(side))]

    def encode(self, texts: list[str]):
        """Identifiers by A and by B of each text; A gets the space that B puts in front."""
        return zip((self.encode_a(" " + x) for x in texts), self.b.encode(texts, num_threads=1), strict=True)

    def groups(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> str:
        """The groups that end with the tokens at ``i`` and ``j``: identifiers of A, then of B, group by group."""
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[i], last_b[j] = True, True
        before_a, before_b = np.append(0, j + 1), i + 1  # tokens of B before A's of a group, of A before B's
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + before_a[np.cumsum(last_a) - last_a]] = a + last_a * len(self.a_bytes)
        out[np.arange(len(b)) + before_b[np.cumsum(last_b) - last_b]] = b + last_b * len(self.b_bytes) + 2 * len(self.a_bytes)
        return "".join(map(self.written.__getitem__, out.tolist()))[:-1]

    def align(self, text: str, a: list[int], b: list[int]):
        """(n_a, n_b, n_groups, n_links, groups, pairs, times) of a text; zeros if tokens do not spell it."""
        target = b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != target or b"".join(map(self.b_bytes.__getitem__, b)) != target:
            return NOTHING
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        place = np.searchsorted(end_b, end_a)  # both end with the text
        i = np.flatnonzero(end_b[place] == end_a)
        j = place[i]
        pairs, times = np.unique(a[i] << 32 | b[j], return_counts=True)
        return len(a), len(b), len(i), len(i), self.groups(a, b, i, j), pairs, times


NOTHING = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


ALIGNERS: dict[str, Aligner] = {}


def aligner(key: str, shared) -> Aligner:
    """The tokenizers of a broadcast pair of files, made once per process; ``key`` is their digest."""
    if key not in ALIGNERS:
        ALIGNERS.clear()
        ALIGNERS[key] = Aligner(*shared.value)
    return ALIGNERS[key]


def encode_both(key: str, shared):
    """(place, doc_id, text) → ``ALIGNED``; some texts at a time."""

    def rows(place, doc_id, found):
        n_a, n_b, n_groups, n_links, groups, pairs, times = zip(*found, strict=True)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in pairs])]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x).astype(t))) for x, t in ((pairs, np.int64), (times, np.int32))]
        counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
        return pa.RecordBatch.from_arrays([place, doc_id, *counts, pa.array(groups, pa.string()), *lists], names=["place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    def run(batches):
        both = aligner(key, shared)
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            begin = 0
            while begin < len(texts):
                end, size = begin + 1, len(texts[begin])
                while end < len(texts) and end - begin < TEXTS_AT_ONCE and size + len(texts[end]) <= BYTES_AT_ONCE:
                    size += len(texts[end])
                    end += 1
                part = texts[begin:end]
                found = [both.align(x, a, b) if x else NOTHING for x, (a, b) in zip(part, both.encode(part), strict=True)]
                yield rows(batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin), found)
                begin = end

    return run


def align(docs: DataFrame, *, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """place, doc_id, n_a, n_b, n_groups, n_links, groups, pairs and times of every row of ``docs``.

    ``groups`` writes the groups' identifiers (``a1,a2|b1;a3|b2,b3``); ``pairs`` has each different pair of linked tokens as
    A * 2^32 + B, ``times`` how often. Texts that are null or empty, or that one of the tokenizers does not spell byte by byte, have zeros and empty values.
    ``place`` numbers the rows; repeated rows have places of their own. The vocabularies are read where this is called, and broadcast.
    """
    spark = docs.sparkSession
    prepare(spark)
    contents = []
    for path in vocabularies or default_vocabularies():
        with open(path, "rb") as file:
            contents.append(file.read())
    key, shared = hashlib.sha256(b"".join(contents)).hexdigest(), spark.sparkContext.broadcast(tuple(contents))
    rows = docs.select(F.monotonically_increasing_id().alias("place"), "doc_id", "text")
    return rows.mapInArrow(encode_both(key, shared), ALIGNED.format(id=dict(rows.dtypes)["doc_id"]))


def packed(lows: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Planes from sorted document numbers, one after the other; ``ends`` of each."""
    data = lows.astype("<u2")
    starts = np.concatenate([[0], ends[:-1]])
    dense = np.flatnonzero(ends - starts >= DENSE)
    if not len(dense):
        offsets = pa.py_buffer((2 * np.concatenate([[0], ends])).astype("<i4").tobytes())
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(data.tobytes())])
    raw, full = data.tobytes(), set(dense.tolist())
    return pa.array([bitmap(data[s:e]) if k in full else raw[2 * s : 2 * e] for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))], pa.binary())


def bitmap(lows: np.ndarray) -> bytes:
    bits = np.zeros(CHUNK, bool)
    bits[lows] = True
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked(plane: bytes) -> np.ndarray:
    """The document numbers of a plane."""
    if len(plane) < CHUNK // 8:
        return np.frombuffer(plane, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little")).astype("<u2")


def planes_of(chunk, pair, low, times):
    """Links of documents → a record batch of ``PLANE``."""
    order = np.lexsort((low, pair, chunk))
    chunk, pair, low, more = chunk[order], pair[order], low[order], times[order] - 1
    out, plane = [], 0
    chosen = np.ones(len(order), bool)
    while True:
        c, p = chunk[chosen], pair[chosen]
        last = np.flatnonzero(np.append((c[1:] != c[:-1]) | (p[1:] != p[:-1]), True))
        bits = packed(low[chosen], last + 1)
        out.append([pa.array(p[last]), pa.array(c[last]), pa.array(np.full(len(last), plane, np.int32)), bits])
        if not more.any():
            return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, names=["pair", "chunk", "plane", "bits"]) for x in out])
        plane += 1
        while not (more & 1).any():
            more, plane = more >> 1, plane + 1
        chosen, more = (more & 1).astype(bool), more >> 1


def invert(batches):
    """(place, pairs, times) → ``PLANE``, some links at a time."""
    held, size = [], 0

    def flush():
        place, pair, times = (np.concatenate(x) for x in zip(*held, strict=True))
        return planes_of(place >> 16, pair, place & (CHUNK - 1), times).to_batches(max_chunksize=10_000)

    for batch in batches:
        lists = batch.column(1)
        place = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False))
        if len(place):
            held.append((place, lists.flatten().to_numpy(zero_copy_only=False), batch.column(2).flatten().to_numpy(zero_copy_only=False)))
            size += len(place)
        if size >= AT_ONCE:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def or_merged(batches):
    """``PLANE`` in the order of pair, chunk and plane → each plane once, with ``n``, its number of documents."""
    held = None

    def merge(table: pa.Table):
        pair, chunk, plane = (table.column(k).to_numpy() for k in range(3))
        bits = table.column(3).combine_chunks()
        first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (chunk[1:] != chunk[:-1]) | (plane[1:] != plane[:-1])))
        runs = np.diff(np.append(first, len(pair)))
        kept, several = bits.take(pa.array(first)), np.flatnonzero(runs > 1)
        if len(several):
            values = kept.to_pylist()
            for k in several:
                lows = functools.reduce(np.union1d, (unpacked(x) for x in bits.slice(first[k], runs[k]).to_pylist()))
                values[k] = lows.astype("<u2").tobytes() if len(lows) < DENSE else bitmap(lows)
            kept = pa.array(values, pa.binary())
        size = np.diff(np.frombuffer(kept.buffers()[1], np.int32, len(kept) + 1, 4 * kept.offset)) if len(kept) else np.zeros(0, np.int64)
        n = size.astype(np.int64) // 2
        for k in np.flatnonzero(size == CHUNK // 8):
            n[k] = int.from_bytes(kept[int(k)].as_py(), "little").bit_count()
        return pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (pair, chunk, plane)] + [kept, pa.array(n)], names=["pair", "chunk", "plane", "bits", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        keys = list(zip(*(table.column(k).slice(max(table.num_rows - 1, 0)).to_pylist() for k in range(3)), strict=True))[0]
        same = np.logical_and.reduce([table.column(k).to_numpy() == keys[k] for k in range(3)])
        cut = int(np.flatnonzero(same)[0])  # the last plane may go on in the next batch
        if cut:
            yield merge(table.slice(0, cut))
        held = table.slice(cut).combine_chunks().to_batches()[0]
    if held is not None:
        yield merge(pa.Table.from_batches([held]))


def returned(batches):
    """(chunk, bits, links, best) in the order of chunks → (place, count_sum, n_best) of its documents."""
    at, sums = None, None

    def out():
        (low,) = sums[0].nonzero()
        return pa.RecordBatch.from_arrays([pa.array((np.int64(at) << 16) + low), pa.array(sums[0][low]), pa.array(sums[1][low])], names=["place", "count_sum", "n_best"])

    for batch in batches:
        chunks, links, best = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
        bits = batch.column(1).to_pylist()
        edges = np.append(np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])), len(chunks)) if len(chunks) else [0]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if chunks[s] != at:
                if at is not None:
                    yield out()
                at, sums = chunks[s], np.zeros((2, CHUNK), np.int64)
            lows = [unpacked(x) for x in bits[s:e]]
            sizes, where = [len(x) for x in lows], np.concatenate(lows)
            np.add.at(sums[0], where, np.repeat(links[s:e], sizes))
            np.add.at(sums[1], where, np.repeat(best[s:e], sizes))
    if at is not None:
        yield out()


def inverted(aligned: DataFrame) -> DataFrame:
    """(place, pairs, times) → (pair, chunk, plane, bits, n): each plane once."""
    planes = aligned.select("place", "pairs", "times").mapInArrow(invert, PLANE)
    planes = planes.repartition("pair", "chunk").sortWithinPartitions("pair", "chunk", "plane")
    return planes.mapInArrow(or_merged, PLANE + ", n bigint")


def weight() -> Column:
    """Links that a document in a plane stands for."""
    return F.when(F.col("plane") == 0, 1).otherwise(F.expr("shiftleft(1L, plane - 1)"))


def pair_counts(planes: DataFrame) -> DataFrame:
    """pair, a, b, n_docs, n_links, rows (planes) and best (has no pair of ``b`` more links?) of all linked pairs."""
    counts = planes.groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("n_docs"), F.sum(F.col("n") * weight()).alias("n_links"), F.count("*").alias("rows")
    )
    counts = materialize(counts.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit(2**32 - 1))}), "pair-counts")
    most = counts.groupBy("b").agg(F.max("n_links").alias("most"))  # as long as B's vocabulary
    return counts.join(F.broadcast(most), "b").withColumn("best", F.col("n_links") == F.col("most")).drop("most")


def scored(docs: DataFrame, *, vocabularies: tuple[str, str] | None = None, of_groups: Column | None = None, max_hot: int = MAX_HOT) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` with its alignment (see ``align``), ``n_best`` and ``count_sum``; and the counts of all pairs.

    ``count_sum``: the corpus-wide number of links of each link's pair, summed over the row's links; ``n_best``: links whose pair has as many
    as any pair of the same B token, ties included. ``of_groups``: what to keep of ``groups``, an expression. Rows without
    tokens have zeros. A null ``doc_id`` is kept; rows are never told apart by it. Other columns do not matter, whatever their names. An empty table gives
    empty results. A text is one value, so it must fit in a task's memory.

    Pairs with over ``1 / max_hot`` of all planes are fewer than ``max_hot``: their counts are broadcast to the planes, others are joined by pair.
    """
    aligned = align(docs, vocabularies=vocabularies)
    if of_groups is not None:
        aligned = aligned.withColumn("groups", of_groups)
    aligned = materialize(aligned, "aligned")
    planes = materialize(inverted(aligned), "planes")
    pairs = materialize(pair_counts(planes), "pairs")

    most = (pairs.agg(F.sum("rows")).first()[0] or 0) / max_hot
    hot, cold = (pairs.where(x).select("pair", "n_links", "best") for x in (F.col("rows") > most, F.col("rows") <= most))
    near = planes.join(F.broadcast(hot), "pair")
    far = planes.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(cold, "pair")
    postings = near.unionByName(far).select("chunk", "bits", (F.col("n_links") * weight()).alias("links"), F.when(F.col("best"), weight()).otherwise(0).cast("long").alias("best"))
    sums = postings.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(returned, "place bigint, count_sum bigint, n_best bigint")
    out = aligned.drop("pairs", "times").join(sums, "place", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}).drop("place"), pairs
