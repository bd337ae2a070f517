"""Near-duplicate components against all pairs, each compared."""

import random
import re
from collections import defaultdict
from math import comb

import numpy as np
import pytest
from conftest import values

from flightlens.llm import lsh_forest
from flightlens.llm.components import components


def sets(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def plain(docs, size, percent=80):
    """(doc_id, n_shingles, component, kept) by comparing all pairs."""
    of = [sets(x, size) for _, x in docs]
    ids = [2**63 - 1 if i is None else i for i, _ in docs]
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            both = len(of[a] & of[b])
            if of[a] and 100 * both >= percent * (len(of[a]) + len(of[b]) - both) and both:
                parent[find(a)] = find(b)
    least = defaultdict(lambda: 2**63 - 1)
    for k in range(len(docs)):
        least[find(k)] = min(least[find(k)], ids[k])
    return sorted((ids[k], len(of[k]), least[find(k)], ids[k] == least[find(k)]) for k in range(len(docs)))


def run(df, **settings):
    return sorted((r.did, r.n_shingles, r.component, r.kept) for r in lsh_forest.linked(df, **settings).collect())


def variants(draw, count, words, edits):
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(words)]
    for _ in range(count):
        text = list(base)
        for _ in range(draw.randint(0, edits)):
            text[draw.randrange(words)] = f"e{draw.randint(0, 10**6)}"
        yield " ".join(text)


def test_groups_of_any_size_and_similarity(spark, rows):
    draw = random.Random(7)
    texts = [x for _ in range(12) for x in variants(draw, draw.randint(2, 6), draw.randint(5, 150), 6)]
    # A cluster with hundreds of members, many of them linked with few others.
    texts += list(variants(draw, 150, 120, 7)) + list(variants(draw, 60, 90, 5)) + [" ".join(f"s{k}x{j}" for j in range(30)) for k in range(40)]
    draw.shuffle(texts)
    docs = list(enumerate(texts))
    assert run(rows("doc_id long, text string", *docs).repartition(6), shingle=4) == plain(docs, 4)


def test_pairs_in_a_dense_region_of_texts_below_the_limit(spark, rows):
    draw = random.Random(11)
    base, own = [f"t{k}" for k in range(172)], lambda k: [f"o{k}x{j}" for j in range(28)]
    texts = []
    for k in range(800):  # 0.754 alike; the first 200 have a partner 0.80 to 0.85 alike
        texts.append(base + own(k))
        if k < 200:
            shared = draw.randint(6, 12)
            texts.append(base + own(k)[:shared] + own(k + 1000)[shared:])
    docs = list(enumerate(" ".join(x) for x in texts))
    draw.shuffle(docs)
    want = plain(docs, 1)
    assert sum(not kept for *_, kept in want) == 200
    assert run(rows("doc_id long, text string", *docs).repartition(4), shingle=1) == want


@pytest.mark.parametrize("shared", [5, 5000])
def test_common_counts(shared):
    draw = np.random.default_rng(3)
    sets_ = [np.unique(draw.integers(0, 2 * shared, shared)) for _ in range(9)]
    elements = np.intersect1d(np.concatenate(sets_[:4]), np.concatenate(sets_[4:]))
    got = lsh_forest.common_counts(sets_[:4], sets_[4:], elements)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets_[4:]] for a in sets_[:4]]


def test_edges(spark, rows):
    long = " ".join(f"w{k}" for k in range(40_000))
    docs = [(1, None), (2, None), (3, ""), (4, " \n"), (5, "One"), (6, "one"), (7, "one two three"), (None, "ONE two  three"), (8, long), (9, long + " end"), (8, long), (8, "other text with the same identifier"), (10, "a b c d e f"), (11, "a b c d e g")]
    df = rows("doc_id long, text string, did string, sig string, component string", *[(i, x, "d", "s", "c") for i, x in docs])
    assert run(df, shingle=5) == plain(docs, 5)
    kept = lsh_forest.keep(df)
    assert kept.columns == df.columns
    got = values(kept.select("doc_id"))
    # Rows without words all stay; of the rows with identifier 8, one of each text.
    assert got == values(rows("doc_id long", 1, 2, 3, 4, 5, 7, 8, 8, 10, 11))
    assert run(df.limit(0)) == [] and lsh_forest.keep(df.limit(0)).collect() == []


def test_many_copies_are_one_node(spark, rows):
    docs = [(k, "the very same text for all of them") for k in range(500)] + [(900, "the very same text for all of us")]
    assert run(rows("doc_id long, text string", *docs), shingle=5) == plain(docs, 5)


def test_components_of_a_long_path_and_a_star(spark, rows):
    name = lambda k: k.to_bytes(4, "big")
    edges = [(name(k), name(k + 1)) for k in range(300)] + [(name(1000), name(1000 + k)) for k in range(1, 200)] + [(name(5), name(5))]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "u binary, v binary").repartition(16)
    got = {bytes(r.node): bytes(r.root) for r in components(df, "test").collect()}
    assert got == {name(k): name(0) for k in range(301)} | {name(1000 + k): name(1000) for k in range(200)}


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_signatures_estimate_the_similarity(similarity):
    draw = np.random.default_rng(1)
    found = []
    for _ in range(60):
        both, own = draw.integers(0, 2**63, int(400 * similarity), dtype=np.uint64), draw.integers(0, 2**63, int(400 * (1 - similarity)), dtype=np.uint64)
        a, b = np.concatenate([both, own[: len(own) // 2]]), np.concatenate([both, own[len(own) // 2 :]])
        small = [lsh_forest.minimum_hashes(lsh_forest.mix(x)).astype(np.uint8) for x in (a, b)]
        found.append(lsh_forest.estimate(*small))
    assert np.mean(found) == pytest.approx(similarity, abs=0.02)


def test_pairs_at_the_limit_are_missed_as_rarely_as_stated():
    n, alike = lsh_forest.HASHES, 0.8 + 0.2 / 256
    dropped = sum(comb(n, k) * alike**k * (1 - alike) ** (n - k) for k in range(n + 1) if lsh_forest.estimate(np.arange(n) < k, True) < 0.8 - lsh_forest.SLACK)
    apart = (1 - 0.8**lsh_forest.DEPTH) ** lsh_forest.TREES
    assert dropped + apart < 3.5e-6
