"""The pipeline, each stage against plain code on the stage's own input."""

import random

from conftest import values
from test_fm_index import plain as hits
from test_host_rules import counted
from test_line_dedup import plain as lines
from test_lsh_forest import plain as groups

import corpus_pipeline
from flightlens.llm import pieces

SF = "/root/testdata/sf0.001"
NAMES = ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]


def test_every_stage_of_the_test_table(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        texts = [(i, r.text) for i, r in before.items()]
        if name == "quality_rules":
            def good(t):
                n, chars, symbols, dup, repeat = counted(t)
                return n >= 50 and 2 * repeat <= n and 10 * symbols <= n and 3 * n <= chars <= 12 * n and 2 * dup <= t.count("\n") + 1

            assert set(after) == {i for i, t in texts if good(t)}  # no host is rejected
        elif name == "line_dedup":
            assert {i: r.text for i, r in after.items()} == {i: t for i, t, _, _ in lines(texts)}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_dedup":
            assert set(after) == {i for i, _, _, kept in groups(texts, 5) if kept}
        elif name == "decontamination":
            assert set(after) == {i for i, t in texts if not hits(t, bench, 13)[3]}
        else:
            p = pieces.load(pieces.default_model())
            assert all(list(r.piece_ids) == list(p.encode(r.text)) and r.exact and r.n_pieces == len(r.piece_ids) for r in after.values())
        if name in ("quality_rules", "near_dedup", "decontamination"):
            assert all(before[i] == r for i, r in after.items())
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_edges(spark, rows):
    draw = random.Random(2)
    text = lambda: " ".join(f"w{draw.randint(0, 10**5)}" for _ in range(80))
    same = text()
    data = [(1, None, "s"), (2, "", None), (3, same, "s"), (4, same, None), (None, text(), "s"), (5, text(), "s"), (5, text(), None)]
    schema = "doc_id long, text string, source string, n_chars long, did string, hits int, piece_ids string"
    docs = rows(schema, *[(i, t, s, 1, "d", 1, "p") for i, t, s in data])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "source", "n_chars", "did", "hits", "piece_ids"]
    assert values(docs.select("doc_id")) == values(rows("doc_id long", 3, None, 5, 5)) or values(docs.select("doc_id")) == values(rows("doc_id long", 3, 4, None, 5, 5))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert all(r.exact for r in last.collect())
    docs = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
