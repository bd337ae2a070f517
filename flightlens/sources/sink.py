"""Writing tables: monthly partitions, snapshots, keyed rows, and the audit of a write."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager, nullcontext
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flightlens.functions.times import month_of
from flightlens.schemas import PERIOD
from flightlens.sources import listing

# Hidden folder of a monthly table: months that were processed without a row.
PROCESSED = "_processed"
# Hidden files of a switch: rows not yet in place, months taken out of it, and the journal.
STAGED, REPLACED, SWITCH = "_staged", "_replaced", "_switch"
# Hidden folder of rows that fit no month, one folder for each load that had some.
REJECTED = "_rejected"
AUDIT = f"{PERIOD[0]} INT, {PERIOD[1]} INT, rows_written BIGINT, total_read BIGINT, total_written BIGINT, total_rejected BIGINT, verified BOOLEAN"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
# A task whose rows come file by file writes no more months than its split has files: 32 by Spark's own sizes (128 MB, 4 MB for opening a file).
OPEN_WRITERS = ("spark.sql.maxConcurrentOutputFileWriters", "32")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of one write."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def overwrite_periods(
    df: DataFrame, path: str, *, by: Sequence[str] = PERIOD, rebalance: bool = False, sort: Sequence[str] = (), bloom: Sequence[str] = ()
) -> None:
    """Replace the months present in ``df`` and leave the others alone.

    Without ``rebalance`` nothing is shuffled: right when each input split holds few
    months. Their files are open side by side, so a task holds what is encoded of its rows, and sorts
    none of them unless it has more months than ``OPEN_WRITERS``. With it, rows of a month are brought together first, and a month far
    larger than the rest is split over several tasks by the adaptive plan.
    """
    if rebalance:
        df = df.hint("rebalance", *by)
    if sort:
        df = df.sortWithinPartitions(*by, *sort)
    options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in bloom}
    with nullcontext() if rebalance or sort else setting(df.sparkSession, *OPEN_WRITERS):
        df.write.mode("overwrite").options(partitionOverwriteMode="dynamic", **options).partitionBy(*by).parquet(path)


class Switched(NamedTuple):
    """Months that got rows, months without a row, and the folder of rows without a month (None: there are none)."""

    filled: list[tuple[int, ...]]
    empty: list[tuple[int, ...]]
    rejected: str | None


def _folder(root: str, by: Sequence[str], period: Sequence[int]) -> str:
    return "/".join([root, *(f"{name}={value}" for name, value in zip(by, period, strict=True))])


def replace_periods(df: DataFrame, path: str, periods: Iterable[tuple[int, ...]], *, by: Sequence[str] = PERIOD, **how) -> list[tuple[int, ...]]:
    """Make ``df`` the content of the given months (of other partitions: ``by``): stored ones that it no longer has are
    deleted, and months without a row are recorded as processed. Returns these months.

    Rows go to a hidden folder first. When all are there, a journal says which months are to be switched; then each month's folder is
    renamed into place. If a run dies before the journal is written, the table is as it was; if it dies later, ``finish_switch`` does the
    rest. Both happen at the beginning of the next call. A table has one writer at a time. Rows without a month are an error.
    """
    return switch_in(df, path, periods, by=by, **how).empty


def switch_in(
    df: DataFrame, path: str, periods: Iterable[tuple[int, ...]], *, by: Sequence[str] = PERIOD, quarantine: bool = False, **how
) -> Switched:
    """``replace_periods``, with all it has done. ``quarantine``: rows without a month are no error, but stored in the table's hidden folder
    of rejected rows."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    finish_switch(spark, path, by=by)
    staged = f"{path}/{STAGED}/{run}"
    overwrite_periods(df, staged, by=by, **how)
    nowhere = "/".join([staged, *(f"{name}={NO_VALUE}" for name in by)])
    rejected = quarantine and listing.exists(spark, nowhere)
    filled = listing.partition_values(spark, staged, by, skip=NO_VALUE if rejected else None)
    empty = sorted(set(periods) - filled)
    listing.write_text(spark, f"{path}/{SWITCH}", json.dumps({"run": run, "filled": sorted(filled), "empty": empty, "rejected": nowhere if rejected else None}))
    return finish_switch(spark, path, by=by)


def finish_switch(spark: SparkSession, path: str, *, by: Sequence[str] = PERIOD) -> Switched:
    """Bring the months of a written journal into place, and clear what an interrupted run has left.

    Every step can be repeated: a month whose staged folder is gone has been switched.
    """
    journal = listing.read_text(spark, f"{path}/{SWITCH}")
    done = Switched([], [], None)
    if journal is not None:
        todo = json.loads(journal)
        run, done = todo["run"], Switched([tuple(p) for p in todo["filled"]], [tuple(p) for p in todo["empty"]], todo["rejected"])
        if done.rejected:
            done = done._replace(rejected=f"{path}/{REJECTED}/{run}")
            if listing.exists(spark, todo["rejected"]):
                listing.make_folder(spark, f"{path}/{REJECTED}")
                listing.rename(spark, todo["rejected"], done.rejected)

        def switch(period: tuple[int, ...]) -> None:
            new, place = _folder(f"{path}/{STAGED}/{run}", by, period), _folder(path, by, period)
            if listing.exists(spark, new):
                if listing.exists(spark, place):
                    listing.rename(spark, place, f"{path}/{REPLACED}/{uuid.uuid4().hex}")
                listing.rename(spark, new, place)

        listing.make_folder(spark, f"{path}/{REPLACED}")
        for parent in {_folder(path, by, p).rsplit("/", 1)[0] for p in done.filled}:
            listing.make_folder(spark, parent)
        listing.each(switch, done.filled)
        listing.delete(spark, [_folder(path, by, p) for p in done.empty])
        if done.empty:
            months = spark.createDataFrame(done.empty, ", ".join(f"{p} INT" for p in by))
            months.coalesce(1).write.mode("append").parquet(f"{path}/{PROCESSED}")
        listing.delete(spark, [f"{path}/{SWITCH}"])
    listing.delete(spark, [f"{path}/{name}" for name in (STAGED, REPLACED) if listing.exists(spark, f"{path}/{name}")])
    return done


def rejected_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of all loads that had no place in a monthly table; None if there are none."""
    return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/{REJECTED}/*") if listing.exists(spark, f"{path}/{REJECTED}") else None


def write_snapshot(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Whole table, replaced or added to."""
    df.write.mode(mode).option("partitionOverwriteMode", "static").parquet(path)


def write_dated_snapshot(df: DataFrame, path: str, date: str | None = None) -> None:
    """One dated copy; writing the same date again replaces it. Today if no date is given."""
    day = F.current_date() if date is None else F.lit(date).cast("date")
    (
        df.withColumn("snapshot_date", day)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(path)
    )


def latest_snapshot(df: DataFrame) -> DataFrame:
    """Rows of the newest dated copy."""
    return df.filter(F.col("snapshot_date") == df.agg(F.max("snapshot_date")).scalar())


def save_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Catalog table, in the warehouse or at ``path``."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def write_keyed(rows: DataFrame, path: str) -> None:
    """Keyed rows in key order, so that a key or prefix lookup skips most row groups."""
    rows.repartitionByRange("rowkey").sortWithinPartitions("rowkey").write.mode("overwrite").parquet(path)


def split_by_month(df: DataFrame, path: str, year: str, yearmonth: str, corrupt: str | None = None) -> DataFrame:
    """Write one partition per month in a single pass and return the audit of the write.

    Records that could not be read (``corrupt`` is not null) and rows without a month are set aside (``rejected_rows``). The input is read once: rows are
    counted on their way to the files, and the files' own counts come from their footers. If the two differ, as they can after a lost
    executor has made a task count twice, both sides are read again.
    """
    spark, seen, one = df.sparkSession, Observation(), F.count(F.lit(1))
    parts = {PERIOD[0]: F.col(year).cast("int"), PERIOD[1]: month_of(F.col(yearmonth))}
    known = parts[PERIOD[0]].isNotNull() & parts[PERIOD[1]].isNotNull()
    if corrupt is not None:
        known &= F.col(corrupt).isNull()
    rows = df.withColumns({name: F.when(known, value) for name, value in parts.items()})
    done = switch_in(rows.observe(seen, one.alias("read")), path, [], quarantine=True, rebalance=True)
    total = seen.get["read"]
    written = listing.row_counts(spark, [_folder(path, PERIOD, p) for p in done.filled])
    (rejected,) = listing.row_counts(spark, [done.rejected]) if done.rejected else (0,)
    verified = total == sum(written) + rejected
    if not verified:
        return audit(spark.read.parquet(path), rows)
    report = [(*p, n, total, sum(written), rejected, verified) for p, n in zip(done.filled, written, strict=True)]
    return spark.createDataFrame(report, AUDIT)


def audit(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows per month as read back next to the rows of the input, for the months of the input
    only; ``verified`` if the totals and every month agree. Rows without a month count as rejected."""
    count = F.count(F.lit(1))
    rejected = rows.filter(F.col(PERIOD[0]).isNull()).count()
    rows = rows.filter(F.col(PERIOD[0]).isNotNull())
    read = rows.groupBy(*PERIOD).agg(count.alias("rows_read"))
    months = read.join(stored.groupBy(*PERIOD).agg(count.alias("rows_written")), PERIOD, "left").fillna(0, ["rows_written"])
    months = months.select(*PERIOD, "rows_read", "rows_written")
    same = months.agg(F.bool_and(F.col("rows_read") == F.col("rows_written"))).scalar()
    report = months.select(
        *PERIOD,
        "rows_written",
        (months.agg(F.sum("rows_read")).scalar() + rejected).alias("total_read"),
        months.agg(F.sum("rows_written")).scalar().alias("total_written"),
        F.lit(rejected).cast("bigint").alias("total_rejected"),
        same.alias("verified"),
    )
    return report.sparkSession.createDataFrame(report.collect(), AUDIT)  # one row per month, as of now
