"""Union, key dedupe, anti, semi and lookup joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Every row of every frame, matched by column name; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def one_per_key(df: DataFrame, key: str, prefer: Sequence[str] = ()) -> DataFrame:
    """One row per key: the one with the largest ``prefer`` columns, then the largest of
    the rest in column order, so the choice does not depend on the layout.

    An aggregate rather than a window: each task reduces its copies of a key to one row
    before the shuffle, so a key with very many copies is no hot spot.
    """
    rest = [*prefer, *[c for c in df.columns if c != key and c not in prefer]]
    best = df.groupBy(key).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_best"))
    fields = {c: F.col(f"_best.`{c}`").alias(c) for c in rest}
    return best.select(*[fields.get(c, F.col(key)) for c in df.columns])


def new_keys_only(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is present and not among the existing ones."""
    return incoming.filter(F.col(key).isNotNull()).join(existing.select(key), key, "left_anti")


def missing_rows(wanted: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct ``on`` values of ``wanted`` that ``present`` lacks."""
    return wanted.select(*on).distinct().join(present.select(*on), list(on), "left_anti")


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether a table is small enough to broadcast: one count, which for stored Parquet
    reads file footers only."""
    return df.count() <= max_rows


def label(df: DataFrame, key: str, codes: DataFrame, code_key: str, code_name: str, as_: str) -> DataFrame:
    """Add the code's name; where the lookup has none, the key itself as text. A code listed
    twice gives one row all the same."""
    lookup = codes.select(F.col(code_key).cast("string").alias("_code"), F.col(code_name).alias("_name"))
    lookup = one_per_key(lookup, "_code")
    joined = df.join(lookup, df[key].cast("string") == F.col("_code"), "left")
    return joined.withColumn(as_, F.coalesce("_name", F.col(key).cast("string"))).drop("_code", "_name")
