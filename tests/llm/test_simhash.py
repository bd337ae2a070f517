import random
import re

import pytest
import xxhash

from conftest import values
from flightlens.llm import simhash
from flightlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{did: smallest did reachable} by comparing all fingerprints."""
    parent = {p: p for p in prints.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for d, p in prints.items():
        least[find(p)] = min(d, least.get(find(p), d))
    return {d: least[find(p)] for d, p in prints.items()}


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: plain_fingerprint(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = plain_components(docs)
    got = QUERIES["op11_simhash_pigeonring"](spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert values(got) == sorted(((d, f"{p:016x}", want[d]) for d, p in docs.items()), key=repr)
    assert any(want[d] != d for d in want)


@pytest.mark.parametrize("text", ["", " \n\t", "one", "One  TWO", "a b c", "É é\x0bx\x1cy A\x00B c d", "word " * 70_000, "x" * 200_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def pairs(found):
    out = set()
    for r in found.collect():
        x, y = (((v % 2**64) << 16 * r.turn | (v % 2**64) >> 64 - 16 * r.turn) % 2**64 for v in (r.x, r.y))
        out.add((min(x, y), max(x, y)))
    return out


@pytest.mark.parametrize("group", [1, 3, 1000])
def test_links_are_those_of_all_pairs_however_crowded(rows, group):
    """Balls around centres, a crowd that shares three segments, one that shares two, and strangers; every level is reached."""
    rng = random.Random(group)

    def near(value, bits, within=64):
        for b in rng.sample(range(within), bits):
            value ^= 1 << b
        return value

    centres = [rng.getrandbits(64) for _ in range(4)] + [0, 2**64 - 1]
    prints = {near(c, k) for c in centres for k in (0, 1, 1, 2, 2, 3, 3, 3, 4, 5)}
    prints |= {centres[0] & ~0xFFFF | rng.getrandbits(16) for _ in range(40)} | {near(centres[1], rng.randint(1, 3), 16) for _ in range(40)}
    prints |= {centres[2] & ~0xFFFFFFFF | rng.getrandbits(32) for _ in range(30)} | {rng.getrandbits(64) for _ in range(30)}
    want = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    df = rows("fp bigint", *[(simhash.signed(p),) for p in sorted(prints)])
    assert pairs(simhash.links(df, group)) == want
    assert len(want) > 100


def test_every_change_of_up_to_three_bits_is_found_by_a_chain():
    """The pigeonring principle over all patterns of counts in four segments."""
    for a in range(4):
        for b in range(4 - a):
            for c in range(4 - a - b):
                for d in range(4 - a - b - c):
                    ring = [a, b, c, d]
                    chains = [[sum((ring * 2)[i : i + k]) for k in range(1, 5)] for i in range(4)]
                    assert any(all(s <= limit for s, limit in zip(chain, simhash.BUDGETS[1:], strict=True)) for chain in chains)


DOCS = "doc_id bigint, text string"


def test_nulls_empty_texts_and_repeated_rows(rows):
    data = [(7, None), (3, ""), (5, " \n"), (None, None), (9, "Some words here to read"), (9, "some words  here TO read"), (2, "some words here to read"), (2, "some words here to read"), (None, "alone in the world")]
    got = [(r.did, r.component, r.kept) for r in simhash.linked(rows(DOCS, *data)).collect()]
    big = 2**63 - 1
    want = [(7, 3, False), (3, 3, True), (5, 3, False), (big, 3, False), (9, 2, False), (9, 2, False), (2, 2, True), (2, 2, True), (big, big, True)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("max_hot", [1, 3, 10_000])
def test_hot_fingerprints(rows, max_hot):
    data = [(i, "the same text again and again" if i % 3 else f"number {i} is a text of its own {i * i}") for i in range(60)]
    got = {r.did: r.component for r in simhash.linked(rows(DOCS, *data), max_hot=max_hot).collect()}
    assert got == plain_components({i: plain_fingerprint(t) for i, t in data})


def test_empty_table_and_clashing_names(rows):
    assert simhash.linked(rows(DOCS)).count() == 0
    df = rows("doc_id bigint, text string, did string, fp string, `a.b` string, component string, n int", (1, "a b c", "?", "?", "?", "?", 1))
    assert values(simhash.linked(df).select("did", "component")) == [(1, 1)]
