"""Lattice likelihood against all segmentations, and the base figures against plain counting."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flightlens.llm import lattice_lm
from flightlens.llm.lattice_lm import Lattice
from test_pieces import TINY, WITH_BYTES

SF = "/root/testdata/sf0.001"
LOGS = [-9.0, -2.0, -1.5, -1.0, -2.5, -1.2, -3.0, -4.0]


def segmentations(text, names):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        if text[:k] in names:
            for rest in segmentations(text[k:], names):
                yield [text[:k], *rest]


def test_sum_over_all_segmentations_and_expected_counts():
    lattice, names = Lattice(TINY, LOGS), {TINY[i][0]: i for i in range(1, 8)}
    for word in map("".join, itertools.product("ab", repeat=5)):
        ways = [[names[x] for x in s] for s in segmentations("▁" + word, names)]
        weight = [math.exp(sum(LOGS[i] for i in s)) for s in ways]
        assert lattice.log_probabilities([word])[0] == pytest.approx(math.log(sum(weight)))
        into, want = np.zeros(len(TINY)), np.zeros(len(TINY))
        lattice.expected([word], np.array([3.0]), into)
        for s, w in zip(ways, weight, strict=True):
            for i in s:
                want[i] += 3.0 * w / sum(weight)
        assert into == pytest.approx(want)


def test_unknown_characters_are_spelled_in_bytes():
    lattice = Lattice(WITH_BYTES, LOGS + [-5.0] * 256)
    words = ["é", "▁", "aéa", "a", "é" * 3000]
    assert lattice.log_probabilities(words)[:2] == pytest.approx([LOGS[1] - 10.0, LOGS[1] - 15.0])
    into = np.zeros(len(WITH_BYTES))
    lattice.expected(["é", "▁"], np.array([2.0, 1.0]), into)
    assert into.sum() == pytest.approx(2 * 3 + 4) and into[8 + 0xC3] == pytest.approx(2.0)


def test_many_words_at_once_are_as_each_alone():
    lattice, draw = Lattice(WITH_BYTES, LOGS + [-5.0] * 256), random.Random(5)
    words = ["".join(draw.choice("aabbxé▁") for _ in range(draw.choice([1, 2, 3, 9, 40]))) for _ in range(300)]
    assert lattice.log_probabilities(words) == pytest.approx([lattice.log_probabilities([w])[0] for w in words])
    times, one, every = np.arange(300.0), np.zeros(len(WITH_BYTES)), np.zeros(len(WITH_BYTES))
    lattice.expected(words, times, every)
    for w, t in zip(words, times, strict=True):
        lattice.expected([w], np.array([t]), one)
    assert every == pytest.approx(one)
    parts = list(lattice_lm.in_parts(["x" * 60_000] * 3 + ["y" * 200_000, "z"]))
    assert parts == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]


def test_scores_are_those_of_one_pass_of_expectation_maximisation(spark, rows, tmp_path):
    """The score as returned, from all segmentations of each word: start weights, expected counts, document sums."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    for piece, value, kind in WITH_BYTES:
        model.pieces.add(piece=piece, score=value, type=kind)
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = True, False
    path = tmp_path / "tiny.model"
    path.write_bytes(model.SerializeToString())
    docs = [(i, t) for i, t in enumerate(["a ab aba", "ba ba b", "", "abab bb a", "aab", "b"] * 3)]
    names = {WITH_BYTES[i][0]: i for i in range(1, 8)}
    start = np.exp(lattice_lm.start_weights(WITH_BYTES))

    def ways(word):
        return [[names[x] for x in s] for s in segmentations("▁" + word, names)]

    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = np.array([float(kind in (1, 6)) for _, _, kind in WITH_BYTES])
    for word in [w for t in train for w in t.split()]:
        weight = [np.prod(start[s]) for s in ways(word)]
        for s, w in zip(ways(word), weight, strict=True):
            np.add.at(counts, s, w / sum(weight))
    total = counts.sum() + len(train) + 1
    want = {i: math.log10((len(train) + 1) / total) + sum(math.log10(sum(np.prod(counts[s] / total) for s in ways(w))) for w in t.split()) for i, t in docs}
    for max_hot in (2, 100_000):
        got = {r.did: r.score for r in lattice_lm.score(rows("doc_id long, text string", *docs), model=str(path), max_hot=max_hot).collect()}
        assert got == pytest.approx(want)


def words(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def check(docs, got):
    train = [x for i, x in docs if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for x in train for w in words(x))
    n, v, ends = sum(counts.values()) + len(train), len(counts) + bool(train), len(train)
    assert len(got) == len(docs)
    by = {r.did: r for r in got}
    for i, x in docs:
        r, w = by[2**63 - 1 if i is None else i], words(x)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r.n_tokens, r.train_tokens) == (len(w) + 1, n)
        assert r.n_known == sum(counts[x] > 0 for x in w) + (ends > 0)
        assert r.base_score == pytest.approx(sum(math.log10((c + 1) / (n + v + 1)) for c in [*(counts[x] for x in w), ends]))
        assert r.score < 0 and math.isfinite(r.score)


def test_base_figures_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = lattice_lm.score(docs, max_hot=50).collect()  # few hot words: most are joined
    check([tuple(r) for r in docs.collect()], got)
    again = {r.did: r.score for r in lattice_lm.score(docs).collect()}
    assert all(r.score == pytest.approx(again[r.did]) for r in got)
    # Longer texts are less likely, and the pieces were learnt: half the weight of a start by rank alone.
    assert np.corrcoef([r.n_tokens for r in got], [r.score for r in got])[0, 1] < -0.9


def test_edges(spark, rows):
    docs = [(1, None), (2, ""), (3, " \n "), (4, "One one"), (5, "x" * 4000), (None, "a b"), (6, "日本 ▁")]
    df = rows("doc_id long, text string, score string", *[(i, x, "?") for i, x in docs])
    check(docs, lattice_lm.score(df).collect())
    twice = lattice_lm.score(df.unionByName(df)).collect()
    assert {r.copies for r in twice} == {2} and len(twice) == len(docs)
    assert lattice_lm.score(df.limit(0)).collect() == []
