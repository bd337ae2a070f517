"""Scans, sinks, catalog tables and incremental loads, as write-then-read round trips.

Each writes the whole derived table into the session's shared scratch folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flightlens import schemas
from flightlens.codes import AIRCRAFT_TYPES, ENGINE_TYPES
from flightlens.functions.keys import plain_cells
from flightlens.operators.combine import missing_rows
from flightlens.plans import loads, serving, views
from flightlens.plans.dimensions import airport_dim as airports_of
from flightlens.registry.lookups import AIRPORT, DELAY_CELLS, MONTHS, YEAR, delays, series_sql
from flightlens.registry.query import case_of, part, query
from flightlens.registry.storms import NEAR, rounded
from flightlens.registry.views import facts
from flightlens.schemas import PERIOD
from flightlens.session import scratch_dir
from flightlens.sources import catalog, scan, sink

part(
    "months_of_flights",
    ("facts",),
    "SELECT year_partition, month_partition, count(*) AS n, CAST(sum(DepartureDelay) AS BIGINT) AS dep_sum FROM facts GROUP BY ALL",
)


CHECKS = "flightlens_check_"  # databases of queries


def months_of(df):
    return df.groupBy(*PERIOD).agg(F.count("*").alias("n"), F.sum("DepartureDelay").alias("dep_sum"))


def bronze_flights(t) -> str:
    """Raw flights as one ``YYYY_M_aotd.parquet`` folder per month."""
    path = fresh(t, "bronze-flights")
    named = t.flights.withColumn("file", F.concat_ws("_", "YEAR", "MONTH", F.lit("aotd.parquet")))
    named.hint("rebalance", "file").write.mode("overwrite").partitionBy("file").parquet(path)
    return path


def fresh(t, name: str) -> str:
    """A new path under the scratch folder on every call."""
    return scratch_dir(t.spark, f"{name}-{uuid.uuid4().hex}")


def _filler(name: str, kind: str) -> str:
    """A value for a column the fixture lacks, as SQL that both engines run; some texts need quotes or escapes."""
    if kind == "int":
        return f"CAST(EVENT_ID % {len(name) + 3} AS INT)"
    if kind == "double":
        return f"CAST(EVENT_ID % {len(name) + 3} AS DOUBLE) / 4"
    return f"concat('{name.lower()}, ', CASE WHEN EVENT_ID % 3 = 0 THEN '\"quoted\"' ELSE 'plain' END, ' ', CAST(EVENT_ID % 7 AS VARCHAR(9)))"


STORM_COLUMNS = [tuple(c.split()) for c in schemas.STORM_CSV.replace("\n", " ").split(",")]
IN_FIXTURE = "BEGIN_YEARMONTH BEGIN_DAY BEGIN_TIME END_YEARMONTH END_DAY END_TIME EVENT_TYPE BEGIN_LAT BEGIN_LON END_LAT END_LON".split()


def storm_column(name: str, kind: str, div: str) -> str:
    if name in IN_FIXTURE:
        return name
    if name == "EVENT_ID":
        return "CAST(EVENT_ID AS INT) AS EVENT_ID"
    return f"{f'CAST(BEGIN_YEARMONTH {div} 100 AS INT)' if name == 'YEAR' else _filler(name, kind.lower())} AS {name}"


def as_published(t, reports) -> str:
    """A folder of CSV files with quotes doubled inside quoted texts."""
    folder = fresh(t, "storm-csv")
    reports.write.options(header=True, quote='"', escape='"').csv(folder)
    return folder


def storm_reports(t):
    """Storm reports with all columns of the CSV."""
    return t.weather.selectExpr(*[storm_column(n, k, "div") for n, k in STORM_COLUMNS])


@query(
    """SELECT year_partition, month_partition, n AS rows_written, CAST(sum(n) OVER () AS BIGINT) AS total_read,
 CAST(sum(n) OVER () AS BIGINT) AS total_written, CAST(0 AS BIGINT) AS total_rejected, true AS verified FROM
 (SELECT CAST(BEGIN_YEARMONTH // 100 AS INT) AS year_partition, CAST(BEGIN_YEARMONTH % 100 AS INT) AS month_partition,
  count(*) AS n FROM fx_weather GROUP BY ALL)""",
    "fx_weather",
)
def bronze_month_split(t):
    """Storm CSV → typed scan → one partition per month → audit."""
    return loads.load_storm_bronze(t.spark, as_published(t, storm_reports(t)), fresh(t, "storm-bronze"))


@query(f"SELECT {', '.join(storm_column(n, k, '//') for n, k in STORM_COLUMNS)} FROM fx_weather", "fx_weather")
def storm_csv_scan(t):
    """All columns of the CSV, each with a value; commas and quotes in the texts."""
    return scan.storm_csv(t.spark, as_published(t, storm_reports(t)))


NARRATIVE = """concat('He said "run, now", twice.', chr(13), chr(10), 'Trees, ', CAST(EVENT_ID % 5 AS VARCHAR(9)), ' of them,', chr(10), chr(10), '"down".')"""


def reports_with_breaks(t):
    """Reports whose narratives have commas, doubled quotes and line breaks."""
    return storm_reports(t).withColumn("EVENT_NARRATIVE", F.expr(NARRATIVE))


def broken_reports(t) -> str:
    """The same reports, and a file with a record that is too short and one with a word for a number."""
    folder = as_published(t, reports_with_breaks(t))
    names = [n for n, _ in STORM_COLUMNS]
    number = ",".join("many" if n == "BEGIN_DAY" else "7" for n in names)
    t.spark.createDataFrame([("\n".join([",".join(names), "1998,too short", number]),)], "value STRING").coalesce(1).write.mode("append").text(folder)
    return folder


@query(f"SELECT {', '.join(storm_column(n, k, '//') if n != 'EVENT_NARRATIVE' else f'{NARRATIVE} AS {n}' for n, k in STORM_COLUMNS)} FROM fx_weather", "fx_weather")
def storm_reports_with_rejects(t):
    """Whole reports after a load with quotes, line breaks and two broken records."""
    bronze = fresh(t, "storm-bronze")
    loads.load_storm_bronze(t.spark, broken_reports(t), bronze)
    return scan.parquet(t.spark, bronze).drop(*PERIOD, loads.CORRUPT)


@query("SELECT '1998,too short' AS record, count(*) + 2 AS total_read, count(*) AS total_written, CAST(2 AS BIGINT) AS total_rejected, true AS verified FROM fx_weather", "fx_weather")
def storm_rejects_counted(t):
    """The rejected records themselves, and how the audit counts them."""
    bronze = fresh(t, "storm-bronze")
    audit = loads.load_storm_bronze(t.spark, broken_reports(t), bronze)
    totals = audit.select("total_read", "total_written", "total_rejected", "verified").distinct()
    short = sink.rejected_rows(t.spark, bronze).filter(F.size(F.split(loads.CORRUPT, ",")) == 2)
    return totals.withColumn("record", short.agg(F.max(loads.CORRUPT)).scalar())


@query(
    f"""SELECT N_NUMBER, trim(MFR) AS MFR, MODEL, TYPE_AIRCRAFT, TRY_CAST(trim(YEAR_MFR) AS INT) AS YEAR_MFR,
 {case_of("trim(TYPE_AIRCRAFT)", AIRCRAFT_TYPES, "'Unknown'")} AS aircraft_type, {case_of("trim(TYPE_ENGINE)", ENGINE_TYPES, "'Invalid'")} AS engine_type
 FROM fx_aircraft""",
    "fx_aircraft",
)
def registry_csv_load(t):
    """Registry CSV → decoded, cleaned, dated copies → newest copy."""
    csv, bronze = fresh(t, "registry-csv"), fresh(t, "registry-bronze")
    raw = t.aircraft.toDF("N-NUMBER", "MFR", "MODEL", "TYPE AIRCRAFT", "TYPE ENGINE", "YEAR MFR")
    raw.write.mode("overwrite").options(header=True, quote='"', escape="\\").csv(csv)
    loads.load_registry_bronze(t.spark, csv, bronze, "2024-05-01")
    loads.load_registry_bronze(t.spark, csv, bronze, "2024-06-01")
    newest = sink.latest_snapshot(scan.parquet(t.spark, bronze))
    return newest.select(
        F.col("`N-NUMBER`").cast("string").alias("N_NUMBER"),
        F.trim("MFR").alias("MFR"),
        "MODEL",
        F.col("TYPE_AIRCRAFT").cast("string").alias("TYPE_AIRCRAFT"),
        F.trim(F.col("YEAR_MFR").cast("string")).try_cast("int").alias("YEAR_MFR"),
        "aircraft_type",
        "engine_type",
    )


@query(
    """SELECT CAST(N_NUMBER AS INT) AS N_NUMBER, MODEL, CAST(TYPE_AIRCRAFT AS INT) AS TYPE_AIRCRAFT FROM fx_aircraft""",
    "fx_aircraft",
)
def registry_csv_inferred(t):
    """Registry CSV with inferred column types."""
    csv = fresh(t, "registry-csv")
    t.aircraft.write.options(header=True, quote='"', escape="\\").csv(csv)
    return scan.registry_csv(t.spark, csv).select("N_NUMBER", "MODEL", "TYPE_AIRCRAFT")


@query(
    """SELECT N_NUMBER, MODEL, CAST('2024-06-01' AS DATE) AS snapshot_date FROM fx_aircraft""",
    "fx_aircraft",
)
def snapshot_latest(t):
    path = fresh(t, "snapshots")
    rows = t.aircraft.select("N_NUMBER", "MODEL")
    sink.write_dated_snapshot(rows.withColumn("MODEL", F.lit("old")), path, "2024-05-01")
    sink.write_dated_snapshot(rows, path, "2024-06-01")
    return sink.latest_snapshot(scan.parquet(t.spark, path))


@query(
    """SELECT CAST(AIRPORT_ID AS VARCHAR) AS AIRPORT_ID, CASE WHEN AIRPORT_ID % 2 = 0 THEN 'Hail' ELSE 'Tornado' END AS EVENT_TYPE,
 1999 AS year_partition, CAST(1 + AIRPORT_ID % 12 AS INT) AS month_partition FROM fx_airports""",
    "fx_airports",
)
def parquet_physical_schema(t):
    path = fresh(t, "weather-keys")
    t.airports.select(
        "AIRPORT_ID",
        F.expr("CASE WHEN AIRPORT_ID % 2 = 0 THEN 'Hail' ELSE 'Tornado' END").alias("EVENT_TYPE"),
        "LATITUDE",
        F.lit(1999).alias("year_partition"),
        F.expr("CAST(1 + AIRPORT_ID % 12 AS INT)").alias("month_partition"),
    ).write.partitionBy(*PERIOD).parquet(path)
    return scan.weather_keys_physical(t.spark, path)


@query(
    """SELECT AIRPORT_ID, LATITUDE, NULL::VARCHAR AS AIRPORT FROM fx_airports
 UNION ALL SELECT AIRPORT_ID, NULL, AIRPORT FROM fx_airport_codes""",
    "fx_airports",
    "fx_airport_codes",
)
def parquet_merged_schema(t):
    path = fresh(t, "merged")
    t.airports.select("AIRPORT_ID", "LATITUDE").write.parquet(f"{path}/part=1")
    t.airport_codes.write.parquet(f"{path}/part=2")
    return scan.parquet(t.spark, path, merge=True).select("AIRPORT_ID", "LATITUDE", "AIRPORT")


@query(
    """SELECT DISTINCT YEAR AS year_partition, MONTH AS month_partition FROM fx_flights ORDER BY 1, 2""",
    "fx_flights",
)
def periods_from_file_names(t):
    path = bronze_flights(t)
    return scan.bronze_periods(t.spark, path, scan.FLIGHT_FILES)


@query(
    """SELECT DISTINCT YEAR AS year_partition, MONTH AS month_partition FROM fx_flights
 EXCEPT SELECT BEGIN_YEARMONTH // 100, BEGIN_YEARMONTH % 100 FROM fx_weather WHERE EVENT_TYPE = 'Tornado'""",
    "fx_flights",
    "fx_weather",
)
def partitions_pending(t):
    """Months with flights but no tornado: raw months against stored months."""
    flights = t.flights.selectExpr("YEAR AS year_partition", "MONTH AS month_partition")
    storms = t.weather.filter("EVENT_TYPE = 'Tornado'").selectExpr(
        "CAST(BEGIN_YEARMONTH div 100 AS INT) AS year_partition", "BEGIN_YEARMONTH % 100 AS month_partition"
    )
    return missing_rows(flights, storms, PERIOD)


@query("SELECT * FROM facts", "facts")
def flights_incremental(t):
    """One month on request, then all pending ones, then nothing left to do."""
    bronze, silver = bronze_flights(t), fresh(t, "silver-flights")
    first = loads.refresh_flights(t.spark, bronze, silver, only=[(1998, 1), (2050, 1)])
    rest = loads.refresh_flights(t.spark, bronze, silver)
    again = loads.refresh_flights(t.spark, bronze, silver)
    if len(first) > 1 or set(first) & set(rest) or again:
        raise AssertionError("a month was processed twice")
    return scan.parquet(t.spark, silver).drop("FactID")


@query("SELECT * FROM months_of_flights WHERE year_partition = 1997", "months_of_flights")
def partition_pruned_scan(t):
    silver = fresh(t, "pruned-flights")
    sink.overwrite_periods(facts(t), silver, rebalance=True)
    return months_of(scan.parquet(t.spark, silver).filter("year_partition = 1997"))


@query(
    """SELECT year_partition, month_partition, true AS known FROM months_of_flights""",
    "months_of_flights",
)
def external_table_partitions(t):
    """External partitioned table over written files: partitions found by repair."""
    silver = fresh(t, "table-flights")
    sink.overwrite_periods(facts(t), silver, rebalance=True)
    base = f"{CHECKS}{uuid.uuid4().hex}"
    catalog.create_database(t.spark, base)
    name = catalog.create_silver(t.spark, "flight_facts", silver, base)
    catalog.refresh(t.spark, name, monthly=True)
    exists = F.lit(catalog.table_exists(t.spark, name))
    return catalog.table_periods(t.spark, name).withColumn("known", exists)


@query("SELECT * FROM delay_carrier", "delay_carrier")
def saved_view_table(t):
    base = f"{CHECKS}{uuid.uuid4().hex}"
    catalog.create_database(t.spark, base)
    name = f"{base}.delay_carrier_month"
    sink.save_table(views.delay_carrier_month(facts(t)), name, fresh(t, "table-carrier"))
    return t.spark.table(name)


@query("SELECT * FROM airports", "airports")
def dimension_incremental(t):
    """Part of the airports stored first; the refresh adds the others and changes nothing."""
    path = fresh(t, "silver-airports")
    airports = airports_of(t.airports)
    known = airports.join(t.airport_codes, F.col("AirportID") == F.col("AIRPORT_ID"), "left_semi")
    loads.refresh_dimension(known, None, path, "AirportID")
    changed = airports.withColumn("AirportName", F.when(F.expr("AirportID % 4 = 3"), F.col("AirportName")).otherwise("x"))
    loads.refresh_dimension(changed, scan.parquet(t.spark, path), path, "AirportID")
    return scan.parquet(t.spark, path)


@query(
    """SELECT AIRPORT_ID, AIRPORT_COUNTRY_NAME, LATITUDE FROM fx_airports WHERE AIRPORT_COUNTRY_NAME = 'Canada'""",
    "fx_airports",
)
def airport_reference_scan(t):
    path = fresh(t, "bronze-airports")
    t.airports.write.parquet(f"{path}/L_AIRPORT_ID.parquet")
    t.airports.write.parquet(f"{path}/other.parquet")
    rows = scan.airport_reference(t.spark, path, country="Canada")
    return rows.select("AIRPORT_ID", "AIRPORT_COUNTRY_NAME", "LATITUDE")


@query("SELECT AIRPORT_ID, AIRPORT FROM fx_airport_codes", "fx_airport_codes")
def code_csv_scan(t):
    path = fresh(t, "codes-csv")
    t.airport_codes.write.option("header", True).csv(path)
    return scan.code_csv(t.spark, path)


@query(series_sql("delay_airport", f"DepartureAirportID = '{AIRPORT}'", DELAY_CELLS), "delay_airport")
def kv_store_lookup(t):
    """Keyed rows written in key order, read back by key."""
    path = fresh(t, "kv-delay")
    sink.write_keyed(delays(t), path)
    return serving.month_series(scan.parquet(t.spark, path), AIRPORT, YEAR, *MONTHS, DELAY_CELLS)


@query(series_sql("delay_airport", f"DepartureAirportID = '{AIRPORT}'", DELAY_CELLS), "delay_airport")
def kv_exported_lookup(t):
    """Rows as a key-value store exports them (``m:name`` → bytes), decoded and looked up."""
    exported = F.transform_values("cells", lambda _, v: F.encode(v, "UTF-8"))
    exported = F.transform_keys(exported, lambda k, _: F.encode(F.concat(F.lit("m:"), k), "UTF-8"))
    rows = delays(t).select("rowkey", exported.alias("cells")).select("rowkey", plain_cells(F.col("cells")).alias("cells"))
    return serving.month_series(rows, AIRPORT, YEAR, *MONTHS, DELAY_CELLS)


@query(
    f"""{NEAR.replace(" FROM events_near", "")}, CAST(BEGIN_YEARMONTH // 100 AS INT) AS year_partition, CAST(BEGIN_YEARMONTH % 100 AS INT) AS month_partition
 FROM events_near JOIN (SELECT EVENT_ID, BEGIN_YEARMONTH FROM fx_weather) ON ORIGINAL_INDEX = EVENT_ID""",
    "events_near",
    "fx_weather",
)
def weather_incremental(t):
    """Storms stored per month; one month matched on request, the others as pending."""
    bronze, silver = fresh(t, "storm-bronze"), fresh(t, "silver-weather")
    sink.split_by_month(t.weather.withColumn("YEAR", F.expr("BEGIN_YEARMONTH div 100")), bronze, "YEAR", "BEGIN_YEARMONTH")
    loads.refresh_weather(t.spark, bronze, t.airports, silver, only=[(1998, 1)])
    loads.refresh_weather(t.spark, bronze, t.airports, silver)
    return rounded(scan.parquet(t.spark, silver))
