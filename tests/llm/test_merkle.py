import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import values
from flightlens.llm import merkle
from flightlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(level, fanout):
    levels = [level]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def path(levels, i, fanout):
    for level in levels[:-1]:
        first = i // fanout * fanout
        yield "".join(level[first:i]), "".join(level[i + 1 : first + fanout])
        i //= fanout


def brute(rows, fanout=2, tampered=lambda row: row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    trees, order = {}, sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for lang in order:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in groups[lang]], fanout)
    top = tree([trees[lang][-1][0] for lang in order], fanout)
    for j, lang in enumerate(order):
        for i, row in enumerate(groups[lang]):
            steps = [*path(trees[lang], i, fanout), *path(top, j, fanout)]
            folded = leaf((*row[:3], row[3] + 1, row[4])) if row[3] is not None and tampered(row) else leaf(row)
            for left, right in steps:
                folded = digest(left, folded, right)
            root = top[-1][0]
            yield row[0], leaf(row), trees[lang][-1][0], root, digest(*(a + b for a, b in steps)), folded, folded == root


SMALL = merkle.Shape(2, 3)
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def made(df, **settings):
    seen = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.one_more("n_chars")).otherwise(F.col("n_chars").cast("string"))
    return values(merkle.manifest(df, seen={"n_chars": seen}, **settings).select(COLUMNS))


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = QUERIES["op13_merkle_manifest"](spark, SF)
    assert got.columns == COLUMNS
    assert values(got) == sorted(brute(rows), key=repr)


SIZES = [("a", 1), ("b", 2), ("c", 27), ("d", 13), (None, 9), ("", 4), ("é", 3), ("z", 8)]


@pytest.mark.parametrize(("fanout", "digits"), [(2, 1), (2, 3), (3, 2), (4, 3)])
def test_storeys_of_blocks(rows, fanout, digits):
    """Full, partial and single blocks; several storeys; groups of every kind of size."""
    data = [(100 * k + i, f"s{i}", lang, i, f"text {i}") for k, (lang, n) in enumerate(SIZES) for i in range(n)]
    assert made(rows(DOCS, *data), shape=merkle.Shape(fanout, digits)) == sorted(brute(data, fanout), key=repr)


def test_nulls_ties_and_repeated_rows(rows):
    data = [(None, None, None, None, None), (None, "", None, 3, ""), (5, None, "x", None, "é" * 50_000), (5, None, "x", None, "b"), (5, None, "x", 2**63 - 1, "a")]
    data += [(7, "s", "x", 1, "same")] * 5 + [(21, "s", "x", -1, "-"), (22, "s", "x", None, "4:nul")]
    assert made(rows(DOCS, *data), shape=merkle.Shape(2, 2)) == sorted(brute(data), key=repr)


def test_every_change_of_a_leaf_column_shows(rows):
    df = rows(DOCS, *[(i, "s", "x", i, f"t{i}") for i in range(20)])
    for column in ("source", "text"):
        changed = F.when(F.col("doc_id") == 11, F.lit("other")).otherwise(F.col(column))
        got = merkle.manifest(df, seen={column: changed}, shape=SMALL)
        assert [r.doc_id for r in got.where(~F.col("verified")).collect()] == [11]
    assert merkle.manifest(df, shape=SMALL).where("verified").count() == 20


def test_empty_table_and_clashing_names(rows):
    assert made(rows(DOCS), shape=SMALL) == []
    data = [(i, "s", "x", i, f"t{i}") for i in range(5)]
    df = rows(DOCS, *data)
    for name in ("part", "key", "h", "node", "rank", "n", "block", "digit_0", "leaf", "root", "a.b"):
        df = df.withColumn(name, F.lit("?"))
    assert made(df, shape=SMALL) == sorted(brute(data), key=repr)


def test_blocks_are_shuffled_once(rows):
    leaves = rows("part string, n bigint, rank bigint, node struct<h:string>", ("x", 2, 0, ("a",)), ("x", 2, 1, ("b",)))
    plan = merkle.nested(leaves, merkle.Shape(2, 4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
