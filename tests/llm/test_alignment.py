import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from conftest import values
from flightlens.llm import alignment
from flightlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    return alignment.Aligner(*(open(path, "rb").read() for path in alignment.default_vocabularies()))


def plain(both, texts):
    """What ``scored`` says, from loops over tokens and links."""
    found, count = [], collections.Counter()
    for text in texts:
        links, groups, p, q = [], [], 0, 0
        (a, b), = both.encode([text or ""])
        spelled = [b"".join(names[i] for i in ids) for ids, names in ((a, both.a_bytes), (b, both.b_bytes))]
        if not text or spelled != [b" " + text.encode()] * 2:
            found.append((0, 0, "", []))
            continue
        end_b, at = {}, 0
        for k, i in enumerate(b):
            at += len(both.b_bytes[i])
            end_b[at] = k
        at = 0
        for k, i in enumerate(a):
            at += len(both.a_bytes[i])
            if at in end_b:
                links.append((i, b[end_b[at]]))
                groups.append(",".join(map(str, a[p : k + 1])) + "|" + ",".join(map(str, b[q : end_b[at] + 1])))
                p, q = k + 1, end_b[at] + 1
        count.update(links)
        found.append((len(a), len(b), ";".join(groups), links))
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    rows = [(n_a, n_b, len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), groups) for n_a, n_b, groups, links in found]
    return rows, count, {x: sum(x in links for links in map(set, (f[3] for f in found))) for x in count}


def test_query_equals_brute_force(spark, both):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows, _, _ = plain(both, [r.text for r in docs])
    got = QUERIES["op12_pair_bitmaps"](spark, SF)
    assert got.columns == COLUMNS
    want = [(d.doc_id, *r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for d, r in zip(docs, rows, strict=True)]
    assert values(got) == sorted(want, key=repr)


TEXTS = [
    None, "", " ", "  two  spaces ", "a <|endoftext|> b </s> <unk> <0x41>", "literal ▁ here", "tab\there\nline\r\n", "naïve café Zürich 東京 ไทย 🙂", "﻿x  y  z", "nul \x00 byte",
    "the the the the the the the", "the same text", "the same text", "x" * 20_000, "word " * 5_000, "ﬁ ligature ① Ａ", "é",
]


@pytest.mark.parametrize("max_hot", [1, 5, 10_000])
def test_texts_of_all_kinds(rows, both, max_hot):
    df = rows("doc_id bigint, text string, place int, pairs string, `a.b` int", *[(None if k == 3 else k // 2, t, 0, "?", 1) for k, t in enumerate(TEXTS)])
    want, count, docs = plain(both, TEXTS)
    got, pairs = alignment.scored(df, max_hot=max_hot)
    assert values(got.select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) == sorted(want, key=repr)
    assert values(got.groupBy("doc_id").count()) == values(df.groupBy("doc_id").count())
    assert {(r.a, r.b): (r.n_links, r.n_docs) for r in pairs.collect()} == {x: (n, docs[x]) for x, n in count.items()}
    assert want[5][0] == 0 and want[4][0] > 0


def test_empty_table(rows):
    got, pairs = alignment.scored(rows("doc_id bigint, text string"))
    assert got.count() == pairs.count() == 0


def batches_of(table, size):
    return table.combine_chunks().to_batches(max_chunksize=size)


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_planes_hold_the_links_whatever_the_batches(size, monkeypatch):
    """Sparse and full planes, several chunks, high multiplicities, parts of a plane from different batches."""
    rng = random.Random(size)
    monkeypatch.setattr(alignment, "AT_ONCE", 20_000)
    links = {(place, 1): rng.choice([1, 1, 1, 2, 3, 9]) for place in range(0, 70_000, 7)}
    links |= {(place, 2): 1 for place in range(65_000)}
    links |= {(place, 3): 1 + 2**20 for place in (5, 65_535, 65_536, 2**33 + 1)}
    by_place = collections.defaultdict(list)
    for (place, pair), n in links.items():
        by_place[place].append((pair, n))
    places = sorted(by_place)
    table = pa.table({
        "place": pa.array(places, pa.int64()),
        "pairs": pa.array([[p for p, _ in by_place[x]] for x in places], pa.list_(pa.int64())),
        "times": pa.array([[n for _, n in by_place[x]] for x in places], pa.list_(pa.int32())),
    })
    parts = pa.Table.from_batches(list(alignment.invert(batches_of(table, 5_000)))).sort_by([("pair", "ascending"), ("chunk", "ascending"), ("plane", "ascending")])
    merged = pa.Table.from_batches(list(alignment.or_merged(batches_of(parts, size))))
    got = collections.Counter()
    for pair, chunk, plane, bits, n in zip(*(merged.column(k).to_pylist() for k in range(5)), strict=True):
        lows = alignment.unpacked(bits).tolist()
        assert n == len(lows) == len(set(lows)) and len(bits) <= 8192
        for low in lows:
            got[chunk * 65_536 + low, pair] += 1 if plane == 0 else 2 ** (plane - 1)
    assert got == links
    assert merged.num_rows < parts.num_rows

    scores = pa.table({"chunk": merged["chunk"], "bits": merged["bits"], "links": pa.array(merged["pair"].to_numpy() * 10), "best": np.ones(merged.num_rows, np.int64)}).sort_by("chunk")
    back = pa.Table.from_batches(list(alignment.returned(batches_of(scores, size * 3)))).to_pydict()
    assert sorted(back["place"]) == places
    assert dict(zip(back["place"], back["n_best"], strict=True))[places[0]] == sum(1 + bin(n - 1).count("1") for _, n in by_place[places[0]])


def test_bytes_of_tokens(both):
    assert both.a_bytes[50256] == b"<|endoftext|>"
    assert b"".join(both.a_bytes[i] for i in both.encode_a(" é\n")) == " é\n".encode()
    assert sorted(x for x in both.b_bytes if len(x) == 1 and x[0] >= 128) == [bytes([b]) for b in range(128, 256)]


def test_identifiers_are_those_of_the_vocabulary_file(spark, both):
    """The faster library against the file's own, with special tokens as plain text."""
    from tokenizers import Tokenizer

    path, _ = alignment.default_vocabularies()
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [t for t in TEXTS if t]
    rng = random.Random(3)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FFF), rng.randrange(0x1F000, 0x1FBFF), 10, 32])) for _ in range(80)) for _ in range(500)]
    assert all(both.encode_a(" " + x) == own.encode(" " + x, add_special_tokens=False).ids for x in texts)


def test_other_vocabularies_use_their_own_library(tmp_path):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    alphabet = {c: b for c, b in sorted(alignment.byte_alphabet().items())}
    vocab = {c: k for k, c in enumerate(alphabet)} | {"ab": 300, "bc": 299}
    tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=[("a", "b"), ("b", "c")]))
    tokenizer.pre_tokenizer, tokenizer.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    content = tokenizer.to_str().encode()
    small = alignment.Aligner(content, open(alignment.default_vocabularies()[1], "rb").read())
    assert small.encode_a("abc") == [300, vocab["c"]] and small.a_bytes[300] == b"ab"
