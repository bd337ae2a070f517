"""A corpus from raw documents: five stages, each written as Parquet and read again.

Every stage works on all rows that the one before has kept. All but the last return the columns
of ``documents``; the last adds the identifiers of the text's pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.llm import fm_index, host_rules, line_dedup, lsh_forest, pieces
from flightlens.llm.common import table
from flightlens.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule or come from a rejected host go: null and empty texts with them, repeated rows alike. Of an
    empty table nothing is left."""
    return host_rules.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their first document only; ``n_chars`` follows the text. No document goes: a null text stays null, an empty
    one empty, and rows with the same ``doc_id`` are one document."""
    df = line_dedup.dedup_lines(docs).select(docs.columns)
    return df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else df


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (shingles of five words, similarity 0.8 or more), once if its row is repeated. Documents without a word
    are in no group and all stay."""
    return lsh_forest.keep(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one word in twenty from benchmark phrases go, repeated rows alike. Null and empty texts have no words and stay; without
    a benchmark all stay."""
    return fm_index.keep(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``piece_ids``, ``n_pieces`` and ``exact``: whether the identifiers decode to the text. A null text has null identifiers, an
    empty one none; columns of these names are replaced."""
    df = pieces.round_trip(docs.drop("piece_ids", "n_pieces", "exact", "decoded"))
    df = df.withColumn("exact", F.col("decoded").eqNullSafe(F.col("text")))
    return df.withColumn("n_pieces", F.size("piece_ids").cast("long")).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", tokenize),
]

# The vocabulary's best segmentation is out of reach for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
