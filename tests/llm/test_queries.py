"""The registered queries on the training tables."""

import pytest

from flightlens.llm.queries import ORACLES, QUERIES
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_names():
    assert [f"op{n}" for n in range(1, 14)] == sorted((x.split("_")[0] for x in QUERIES if x.startswith("op")), key=lambda x: int(x[2:]))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


COLUMNS = {
    "op2_sentencepiece": ["doc_id", "piece_ids", "n_pieces", "exact"],
    "op3_token_counts": ["doc_id", "n_chars", "n_tokens", "token_score"],
    "op4_lattice_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op9_link_graph": ["page_id", "host", "path", "rule", "verdict"],
    "op10_language_mixture": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_per_row_of_the_table(spark, name):
    df = QUERIES[name](spark, SF)
    table = "pages" if "page_id" in df.columns else "documents"
    assert df.columns == COLUMNS[name]
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
