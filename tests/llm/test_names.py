"""Column names with dots and back-quotes pass through every operator that keeps the columns of its rows."""

import pytest
from pyspark.sql import functions as F

from flightlens.llm import fm_index, host_rules, line_dedup, lsh_forest, pieces, url_filters

WORDS = " ".join(f"word{i} and" for i in range(60))


@pytest.fixture
def docs(rows):
    return rows("doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `did` string, `q``t` int", (1, WORDS, "en", "s", 9, "x", "d", 1), (2, WORDS, "en", "s", 9, "y", "d", 2), (3, None, None, None, None, None, None, None))


OPERATORS = {
    "host_rules": host_rules.keep,
    "line_dedup": lambda df: line_dedup.dedup_lines(df).drop("n_lines", "n_dropped"),
    "lsh_forest": lsh_forest.keep,
    "fm_index": lambda df: fm_index.keep(df, df.sparkSession.createDataFrame([("i", "nothing of this")], "item_id string, text string")),
    "pieces": lambda df: pieces.round_trip(df).drop("piece_ids", "decoded"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_of_documents(docs, name):
    out = OPERATORS[name](docs)
    assert out.columns == docs.columns
    assert {r["a.b"] for r in out.collect()} <= {"x", "y", None} and out.count() >= 1


def test_columns_of_pages(rows):
    pages = rows("page_id long, url string, html string, `a.b` string", (1, "http://x.net/a", "<p>", "x"), (2, None, None, None))
    out = url_filters.judge_urls(pages)
    assert out.columns == ["page_id", "url", "html", "a.b", "host", "path", "rule", "verdict"]
    assert out.where(F.col("`a.b`") == "x").first().verdict == "block"
