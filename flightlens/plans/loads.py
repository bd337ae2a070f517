"""Whole loads: raw files → bronze → silver → views → keyed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flightlens.operators.checks import clean_names
from flightlens.operators.combine import missing_rows, union_all
from flightlens.plans.dimensions import airport_dim, aircraft_dim, decoded_registry, refresh_dimension
from flightlens.plans.flights import flight_facts
from flightlens.plans.serving import keyed_view
from flightlens.plans.storms import RADIUS_KM, aligned_storms, storms_near_airports
from flightlens.plans.views import build_views
from flightlens.schemas import AIRCRAFT_DIM, AIRPORT_DIM, PERIOD
from flightlens.session import materialize
from flightlens.sources import catalog, listing, scan, sink


CORRUPT = "_corrupt_record"


def load_storm_bronze(spark: SparkSession, csv_path: str, bronze: str, *, multiline: bool = True) -> DataFrame:
    """Storm CSV files → one partition per month; returns the audit of the write.

    Records that do not fit the columns, and reports without a month, are set aside beside the table (``sink.rejected_rows``) and counted by the audit. The
    text of such a record is in ``_corrupt_record``, a column that is null in all stored months.
    """
    return sink.split_by_month(scan.storm_csv(spark, csv_path, corrupt=CORRUPT, multiline=multiline), bronze, "YEAR", "BEGIN_YEARMONTH", CORRUPT)


def load_registry_bronze(spark: SparkSession, csv_path: str, bronze: str, date: str | None = None) -> DataFrame:
    """Aircraft registry → a dated copy with both type codes decoded; returns the audit of the write.

    Columns stay text: types inferred from each day's file differ from day to day (a year
    column with and without blanks), and such copies could not be read together. Rows are counted as they are written; the files' own counts come from
    their footers. If they differ, as after a lost executor, the input is counted again.
    """
    raw, seen, one = scan.registry_csv(spark, csv_path, infer=False), Observation(), F.count(F.lit(1))
    day = date or str(spark.range(1).select(F.current_date()).first()[0])
    sink.write_dated_snapshot(clean_names(decoded_registry(raw)).observe(seen, one.alias("read")), bronze, day)
    (written,) = listing.row_counts(spark, [f"{bronze}/snapshot_date={day}"])
    read = seen.get["read"] if seen.get["read"] == written else raw.count()
    report = spark.createDataFrame([(day, read, written, read == written)], "snapshot_date STRING, rows_read BIGINT, rows_written BIGINT, verified BOOLEAN")
    return report.withColumn("snapshot_date", F.col("snapshot_date").cast("date"))


class MonthsFailed(RuntimeError):
    """Some months could not be processed; the others were. ``failed``: month → error; ``done``: months."""

    def __init__(self, failed: dict, done: list):
        super().__init__(f"months failed: {', '.join(f'{y}-{m:02d}' for y, m in sorted(failed))}; first error: {next(iter(failed.values()))}")
        self.failed, self.done = failed, done


def _all_or_halves(todo: list[tuple[int, int]], run: Callable[[list[tuple[int, int]]], object]) -> None:
    """All months in one go. If that fails, each half by itself, so that a bad month among n costs some 2 log n runs
    and stops no other."""

    def attempt(part: list[tuple[int, int]]) -> dict[tuple[int, int], Exception]:
        try:
            run(part)
        except Exception as error:
            if len(part) == 1:
                return {part[0]: error}
            middle = len(part) // 2
            return attempt(part[:middle]) | attempt(part[middle:])
        return {}

    if failed := attempt(todo):
        raise MonthsFailed(failed, [m for m in todo if m not in failed]) from next(iter(failed.values()))


def pending_periods(bronze: DataFrame, stored: DataFrame) -> DataFrame:
    """Months that have a raw file but no stored partition."""
    return missing_rows(bronze, stored, PERIOD)


def choose_periods(
    bronze: DataFrame, stored: DataFrame, *, only: Iterable[tuple[int, int]] | None = None, full: bool = False
) -> list[tuple[int, int]]:
    """Months to process: the listed ones that exist, all of them, or the pending ones.
    At most one entry per calendar month comes to the driver."""
    if only is not None:
        wanted = set(only)
        return sorted(p for p in map(tuple, bronze.select(*PERIOD).distinct().collect()) if p in wanted)
    todo = bronze.select(*PERIOD).distinct() if full else pending_periods(bronze, stored)
    return sorted(map(tuple, todo.collect()))


def refresh_flights(
    spark: SparkSession, bronze: str, silver: str, *, only=None, full: bool = False, table: str | None = None
) -> list[tuple[int, int]]:
    """Process new, listed or all months of raw flights; returns the months processed.

    One plan for all months, without a shuffle: files are projected and written under the
    month of the file, each kind of file with its own types. A processed month without a row
    loses what it had stored and is not pending again. ``table``: a catalog table over
    ``silver`` that shall see the months. Raises ``MonthsFailed`` after the others are done.
    """
    months = scan.named_months(spark, bronze, scan.FLIGHT_FILES)
    todo = choose_periods(scan.bronze_periods(spark, bronze, scan.FLIGHT_FILES), scan.processed_periods(spark, silver), only=only, full=full)

    def run(part: list[tuple[int, int]]) -> None:
        with scan.month_frames(spark, bronze, [m for m in months if m[:2] in set(part)], scan.FLIGHT_FILES) as frames:
            sink.replace_periods(union_all([_facts_of_file_month(raw) for raw in frames]), silver, part)

    if todo:
        _all_or_halves(todo, run)
    if table:
        catalog.refresh(spark, table, monthly=True)
    return todo


def _facts_of_file_month(raw: DataFrame) -> DataFrame:
    """Facts in the month of their file, whatever the record itself says."""
    facts = flight_facts(raw, keep=[F.col(p).alias(f"_file_{p}") for p in PERIOD])
    return facts.drop(*PERIOD).withColumnsRenamed({f"_file_{p}": p for p in PERIOD})


def refresh_weather(
    spark: SparkSession,
    bronze: str,
    airports: DataFrame,
    silver: str,
    *,
    only=None,
    full: bool = False,
    radius_km: float = RADIUS_KM,
    country: str | None = None,
    table: str | None = None,
) -> list[tuple[int, int]]:
    """Match new, listed or all months of storms to airports; returns the months processed.

    ``bronze`` holds files or folders named by month, or the partitions ``load_storm_bronze``
    writes, or both; a month that has a partition is read from there only. Rows stay in the
    month of their file even where a storm runs into the next one. A processed month without
    a pair loses what it had stored and is not pending again. ``table`` as for flights.
    """
    stored = scan.partition_months(spark, bronze)
    ours = {m[:2] for m in stored}
    months = stored + [m for m in scan.named_months(spark, bronze, scan.STORM_FILES) if m[:2] not in ours]
    found = spark.createDataFrame(sorted({m[:2] for m in months}), ", ".join(f"{p} INT" for p in PERIOD))
    todo = choose_periods(found, scan.processed_periods(spark, silver), only=only, full=full)

    def run(part: list[tuple[int, int]]) -> None:
        with scan.month_frames(spark, bronze, [m for m in months if m[:2] in set(part)], scan.STORM_FILES) as frames:
            storms = union_all([aligned_storms(raw) for raw in frames])
            pairs = storms_near_airports(storms, airports, radius_km, country=country)
            order = ["ORIGINAL_WEATHER_INDEX", "HOUR_OFFSET", "DISTANCE_KM"]
            sink.replace_periods(pairs, silver, part, rebalance=True, sort=order)

    if todo:
        _all_or_halves(todo, run)
    if table:
        catalog.refresh(spark, table, monthly=True)
    return todo


def refresh_airports(spark: SparkSession, bronze: str, silver: str, *, full: bool = False, table: str | None = None) -> bool:
    """Returns False, and leaves the table alone, if no file matches."""
    paths = scan.named_files(spark, bronze, scan.AIRPORT_FILES)
    if not paths:
        return False
    incoming = airport_dim(scan.read_files(spark, paths))
    refresh_dimension(incoming, _stored(spark, silver, AIRPORT_DIM), silver, "AirportID", "full" if full else "insert_new")
    if table:
        catalog.refresh(spark, table)
    return True


def refresh_aircraft(spark: SparkSession, bronze: str, silver: str, *, full: bool = False, table: str | None = None, **columns: str) -> bool:
    """``bronze`` holds dated files, the dated partitions ``load_registry_bronze`` writes, or both.
    The newest copy of a tail number counts. Returns False, and leaves the table alone, if
    there is no copy."""
    raw = scan.registry_snapshots(spark, bronze)
    if raw is None:
        return False
    incoming = aircraft_dim(raw, prefer=["snapshot_date"], **columns)
    refresh_dimension(incoming, _stored(spark, silver, AIRCRAFT_DIM), silver, "TailNum", "full" if full else "insert_new")
    if table:
        catalog.refresh(spark, table)
    return True


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    return scan.parquet(spark, path, schema=schema) if listing.entries(spark, path) else None


def serve(
    spark: SparkSession, store: str, *, silver: str = "silver", serving: str = "serving", on_null: str = "collapse"
) -> list[str]:
    """Build every view whose silver tables exist, save it as a table and as keyed rows
    under ``store``; returns the view names. Flight and airport tables must exist; all are
    refreshed first, so every stored month counts."""
    for table in ("flight_facts", "airport_dim"):
        if not catalog.table_exists(spark, f"{silver}.{table}"):
            raise ValueError(f"missing table: {silver}.{table}")
    for table, (_, monthly) in catalog.SILVER_TABLES.items():
        if catalog.table_exists(spark, f"{silver}.{table}"):
            catalog.refresh(spark, f"{silver}.{table}", monthly=monthly)
    catalog.create_database(spark, serving)
    views = build_views(
        spark.table(f"{silver}.flight_facts"),
        spark.table(f"{silver}.airport_dim"),
        catalog.optional_table(spark, f"{silver}.weather_airport_events"),
        catalog.optional_table(spark, f"{silver}.aircraft_dim"),
        shared=materialize,
    )
    for name, view in views.items():
        sink.save_table(view, f"{serving}.{name}")
        sink.write_keyed(keyed_view(name, spark.table(f"{serving}.{name}"), on_null), f"{store}/{name}")
    return list(views)
