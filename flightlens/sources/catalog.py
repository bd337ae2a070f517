"""Databases and external tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens import schemas
from flightlens.schemas import PERIOD

# Silver tables: name → (columns, partitioned by month).
SILVER_TABLES = {
    "flight_facts": (schemas.FLIGHT_FACTS, True),
    "airport_dim": (schemas.AIRPORT_DIM, False),
    "aircraft_dim": (schemas.AIRCRAFT_DIM, False),
    "weather_airport_events": (schemas.WEATHER_EVENTS, True),
}


def _text(value: str) -> str:
    """SQL text literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


def create_external(
    spark: SparkSession, name: str, columns: str, path: str, *, monthly: bool = False, by: Sequence[str] = PERIOD, replace: bool = False
) -> None:
    """Table over files at ``path``; dropping it keeps the files. ``monthly``: in partitions, by month or by other whole numbers."""
    if replace:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    period = ", ".join(f"{c} INT" for c in by)
    body = f"{columns}, {period}" if monthly else columns
    partitioned = f"PARTITIONED BY ({', '.join(by)})" if monthly else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({body}) USING parquet {partitioned} LOCATION {_text(path)}")


def add_months(spark: SparkSession, name: str, months: Iterable[tuple[int, int, str]]) -> None:
    """Partitions of a monthly table at given places."""
    specs = [
        f"PARTITION ({PERIOD[0]}={year}, {PERIOD[1]}={month}) LOCATION {_text(path)}"
        for year, month, path in months
    ]
    spark.sql(f"ALTER TABLE {name} ADD {' '.join(specs)}")


def create_silver(spark: SparkSession, table: str, path: str, database: str = "silver", *, replace: bool = False) -> str:
    columns, monthly = SILVER_TABLES[table]
    name = f"{database}.{table}"
    create_external(spark, name, columns, path, monthly=monthly, replace=replace)
    return name


def refresh(spark: SparkSession, name: str, *, monthly: bool = False) -> None:
    """Make newly written files visible, new month folders known, and deleted ones forgotten."""
    if monthly:
        spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
    spark.catalog.refreshTable(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def optional_table(spark: SparkSession, name: str) -> DataFrame | None:
    """The table, or None if there is none."""
    return spark.table(name) if table_exists(spark, name) else None


def table_periods(spark: SparkSession, name: str) -> DataFrame:
    """(year, month) of a table's partitions, from the catalog; no file is read."""
    found = spark.sql(f"SHOW PARTITIONS {name}")
    return found.select(
        *[F.regexp_extract("partition", rf"{c}=(\d+)", 1).try_cast("int").alias(c) for c in PERIOD]
    )
