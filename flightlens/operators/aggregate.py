"""Flight statistics that can be merged, profiles and ranked counts.

A view's averages and rates come from sums and counts. Those can be added up, so one
scan of the flights at a fine grain serves every coarser view, and a dimension is
joined to the few aggregated rows instead of to every flight. Spark combines partial
sums before it shuffles: a key that holds a third of all flights sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightlens.functions.values import percent

STAT_PARTS = ["dep_sum", "dep_n", "arr_sum", "arr_n", "cancel_cnt", "flag_n", "flights_cnt"]


def collect_stats(flights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mergeable flight statistics per key. Parts no measure uses are pruned by Catalyst."""
    cancelled = F.col("IsCancelledFlag")
    return flights.groupBy(*keys).agg(
        F.sum("DepartureDelay").alias("dep_sum"),
        F.count("DepartureDelay").alias("dep_n"),
        F.sum("ArrivalDelay").alias("arr_sum"),
        F.count("ArrivalDelay").alias("arr_n"),
        F.count_if(cancelled).alias("cancel_cnt"),
        F.count(cancelled).alias("flag_n"),
        F.count(F.lit(1)).alias("flights_cnt"),
    )


def merge_stats(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics at a coarser grain."""
    return stats.groupBy(*keys).agg(*[F.sum(part).alias(part) for part in STAT_PARTS])


def _mean(total: str, n: str) -> Column:
    return F.try_divide(F.col(total).cast("double"), F.col(n))


MEASURES = {
    "avg_dep_delay": lambda: _mean("dep_sum", "dep_n"),
    "avg_arr_delay": lambda: _mean("arr_sum", "arr_n"),
    "flights_cnt": lambda: F.col("flights_cnt"),
    "cancel_cnt": lambda: F.col("cancel_cnt"),
    # A missing flag counts as not cancelled here ...
    "cancel_pct": lambda: percent(F.col("cancel_cnt"), F.col("flights_cnt")),
    # ... but is left out of the rate.
    "cancel_rate": lambda: _mean("cancel_cnt", "flag_n"),
}


def finish(stats: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Final measures of collected statistics."""
    return stats.select(*keys, *[MEASURES[m]().alias(m) for m in measures])


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group. With the filter next to the window, Spark keeps
    only ``n`` rows per group and task before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def top_groups(df: DataFrame, key: str, n: int, *, weight: str | None = None, count_as: str = "n") -> DataFrame:
    """The ``n`` keys with most rows, or with the largest sum of ``weight``; ties by key."""
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    totals = df.groupBy(key).agg(amount.alias(count_as))
    return totals.orderBy(F.col(count_as).desc_nulls_last(), F.col(key)).limit(n)


def group_count(df: DataFrame, key: str, count_as: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(count_as))


def profile(df: DataFrame, rows: str, distinct: dict[str, str], least: dict[str, str], most: dict[str, str]) -> DataFrame:
    """One row: row count, distinct counts, minima and maxima; dicts map output name → column."""
    return df.agg(
        F.count(F.lit(1)).alias(rows),
        *[F.countDistinct(col).alias(name) for name, col in distinct.items()],
        *[F.min(col).alias(name) for name, col in least.items()],
        *[F.max(col).alias(name) for name, col in most.items()],
    )
