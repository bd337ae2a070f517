"""Ranks to wide rows and back, matrices, dense month axes, declared orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranks_to_columns(ranked: DataFrame, group: Sequence[str], values: dict[str, str], n: int, rank: str = "rank") -> DataFrame:
    """One row per group with ``rankNN_<name>`` for every rank up to ``n``.

    Groups are already together after the ranking window, so this adds no shuffle.
    """
    at = {i: F.col(rank) == i for i in range(1, n + 1)}
    return ranked.groupBy(*group).agg(
        *[
            F.max(F.when(at[i], F.col(col))).alias(f"rank{i:02d}_{name}")
            for i in at
            for name, col in values.items()
        ]
    )


def rows_from(positions: Sequence[tuple], names: Sequence[str]) -> Column:
    """One output row per tuple of values: the inverse of a pivot."""
    rows = [F.struct(*[v.alias(n) for v, n in zip(row, names, strict=True)]) for row in positions]
    return F.inline(F.array(*rows))


def matrix(df: DataFrame, row: str, col: str, value: str, columns: Sequence, prefix: str = "") -> DataFrame:
    """Mean of ``value`` per row and column. ``columns`` fixes the header, so Spark needs
    no extra job to find it and columns without data are kept."""
    wide = df.filter(F.col(value).isNotNull()).groupBy(row).pivot(col, list(columns)).agg(F.avg(value))
    return wide.select(row, *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in columns])


def dense_axis(df: DataFrame, axis: str, first: int, last: int) -> DataFrame:
    """Every integer from ``first`` to ``last``, with NULLs where ``df`` has no row."""
    spine = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(axis))
    return spine.join(df, axis, "left")


def declared_order(col: str, order: Sequence[str]) -> Column:
    """Sort key that follows a given order of categories; others come last."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(col))
    return F.when(place > 0, place).asc_nulls_last()
