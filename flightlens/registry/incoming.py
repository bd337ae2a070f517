"""Loads from files that differ in layout, columns and types; reprocessed months; catalog tables.

Each writes the whole derived table into the session's shared scratch folder first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flightlens import schemas
from flightlens.functions.values import rounded as rounded_value
from flightlens.operators.combine import union_all
from flightlens.operators.spatial import within_radius
from flightlens.plans import loads
from flightlens.plans.dimensions import aircraft_dim, airport_dim
from flightlens.plans.storms import storms_near_airports
from flightlens.registry.query import query
from flightlens.registry.storage import CHECKS, bronze_flights, fresh, months_of
from flightlens.registry.storms import NEAR, rounded
from flightlens.registry.views import dated_storms, facts
from flightlens.schemas import PERIOD
from flightlens.sources import catalog, listing, scan, sink

MONTH = "BEGIN_YEARMONTH % 100"


def plain_files(df, parts: str, path: str) -> None:
    """Files ``<file>_<number>.parquet`` directly in ``path`` for each value of ``file``, instead of folders of part files."""
    df.hint("rebalance", "file").write.partitionBy("file").parquet(parts)
    for folder in sorted(n for n in listing.names_in(df.sparkSession, parts) if n.startswith("file=")):
        files = sorted(n for n in listing.names_in(df.sparkSession, f"{parts}/{folder}") if n.startswith("part-"))
        for k, part in enumerate(files):
            listing.rename(df.sparkSession, f"{parts}/{folder}/{part}", f"{path}/{folder.removeprefix('file=')}_{k}.parquet")


def mixed_storms(t) -> str:
    """Bronze storms in three layouts: months 1-4 as partitions, 5-11 as folders named by month,
    December as plain files, one or more a year, but for one year that is a folder of part files."""
    path = fresh(t, "mixed-storms")
    storms = t.weather.withColumn("YEAR", F.expr("BEGIN_YEARMONTH div 100"))
    sink.split_by_month(storms.filter(f"{MONTH} <= 4"), path, "YEAR", "BEGIN_YEARMONTH")
    text = storms.filter(f"{MONTH} BETWEEN 5 AND 11").withColumn("EVENT_ID", F.col("EVENT_ID").cast("string"))
    name = F.format_string("storm_events_%04d_%02d.parquet", F.col("YEAR").cast("int"), F.expr(MONTH))
    text.withColumn("file", name).hint("rebalance", "file").write.mode("append").partitionBy("file").parquet(f"{path}/named")
    december = storms.filter(f"{MONTH} = 12")
    december.filter("YEAR = 1995").write.parquet(f"{path}/storm_events_1995_12.parquet")
    name = F.format_string("storm_events_%04d_12", F.col("YEAR").cast("int"))
    plain_files(december.filter("YEAR <> 1995").withColumn("file", name), fresh(t, "december-parts"), path)
    return path


@query(NEAR, "events_near")
def weather_from_all_layouts(t):
    """Plain files, folders and partitions side by side, identifiers as numbers and as text: no month is lost."""
    silver = fresh(t, "silver-weather")
    loads.refresh_weather(t.spark, mixed_storms(t), t.airports, silver)
    return rounded(scan.parquet(t.spark, silver).drop(*PERIOD))


@query(NEAR + " WHERE km <= 20", "events_near")
def weather_smaller_radius(t):
    """50 km first, then every month again at 20 km: nothing of the first run is left."""
    bronze, silver = fresh(t, "storm-bronze"), fresh(t, "silver-weather")
    sink.split_by_month(t.weather.withColumn("YEAR", F.expr("BEGIN_YEARMONTH div 100")), bronze, "YEAR", "BEGIN_YEARMONTH")
    loads.refresh_weather(t.spark, bronze, t.airports, silver, radius_km=50)
    loads.refresh_weather(t.spark, bronze, t.airports, silver, radius_km=20, full=True)
    if loads.refresh_weather(t.spark, bronze, t.airports, silver, radius_km=20):
        raise AssertionError("months without a pair are pending for ever")
    stored = scan.parquet(t.spark, silver, schema=f"{schemas.WEATHER_EVENTS}, {PERIOD[0]} INT, {PERIOD[1]} INT")  # there may be no pair
    return rounded(stored.drop(*PERIOD))


@query("SELECT * FROM aircraft", "aircraft")
def aircraft_from_both_layouts(t):
    """A dated file of old rows and a newer dated partition: the newest copy of each aircraft counts."""
    bronze, silver = fresh(t, "registry"), fresh(t, "silver-aircraft")
    old = t.aircraft.withColumn("MODEL", F.when(F.expr("N_NUMBER % 3 = 0"), F.col("MODEL")).otherwise("old"))
    old.write.parquet(f"{bronze}/plane_registry_2024-05-01.parquet")
    sink.write_dated_snapshot(t.aircraft.filter("N_NUMBER % 3 <> 0").withColumn("TYPE_ENGINE", F.col("TYPE_ENGINE").cast("int")), bronze, "2024-06-01")
    loads.refresh_aircraft(t.spark, bronze, silver)
    return scan.parquet(t.spark, silver)


@query(
    """SELECT AirportID, AirportStateName, AirportName, AirportCityName,
 CASE WHEN AirportID % 2 = 0 THEN Latitude END AS Latitude, Longitude FROM airports""",
    "airports",
)
def airports_from_differing_files(t):
    """Two matching files with other columns and types, next to a file that does not match."""
    bronze, silver = fresh(t, "bronze-airports"), fresh(t, "silver-airports")
    t.airports.filter("AIRPORT_ID % 2 = 0").write.parquet(f"{bronze}/airports_a.parquet")
    odd = t.airports.filter("AIRPORT_ID % 2 = 1").drop("LATITUDE")
    odd.withColumn("AIRPORT_ID", F.col("AIRPORT_ID").cast("string")).write.parquet(f"{bronze}/L_AIRPORT_ID.parquet")
    t.airport_codes.write.parquet(f"{bronze}/a_notes.parquet")
    loads.refresh_airports(t.spark, bronze, silver)
    return scan.parquet(t.spark, silver)


@query("SELECT * REPLACE (CASE WHEN month_partition % 3 <> 1 THEN DepartureTimeBlock END AS DepartureTimeBlock) FROM facts", "facts")
def flights_with_differing_types(t):
    """Delays as whole numbers, decimals or text, and one column missing, by month: read by default."""
    bronze, silver = fresh(t, "bronze-flights"), fresh(t, "silver-flights")
    file = F.concat_ws("_", "YEAR", "MONTH", F.lit("aotd.parquet"))
    for k, kind in enumerate(["int", "double", "string"]):
        part = t.flights.filter(f"MONTH % 3 = {k}").withColumn("DEP_DELAY", F.col("DEP_DELAY").cast(kind))
        part = part.drop("DEP_TIME_BLK") if k == 1 else part
        part.withColumn("file", file).hint("rebalance", "file").write.mode("append").partitionBy("file").parquet(bronze)
    loads.refresh_flights(t.spark, bronze, silver)
    return scan.parquet(t.spark, silver).drop("FactID")


@query("SELECT * REPLACE (CASE WHEN CAST(substr(CarrierCode, 2) AS INT) % 3 <> 1 THEN DepartureTimeBlock END AS DepartureTimeBlock) FROM facts", "facts")
def flights_with_differing_part_files(t):
    """The part files of one month's folder differ: delays as whole numbers, decimals or text, and one column missing, by carrier."""
    bronze, silver = fresh(t, "bronze-flights"), fresh(t, "silver-flights")
    file = F.concat_ws("_", "YEAR", "MONTH", F.lit("aotd.parquet"))
    for k, kind in enumerate(["int", "double", "string"]):
        part = t.flights.filter(f"CAST(substr(OP_CARRIER, 2) AS INT) % 3 = {k}").withColumn("DEP_DELAY", F.col("DEP_DELAY").cast(kind))
        part = part.drop("DEP_TIME_BLK") if k == 1 else part
        part.withColumn("file", file).hint("rebalance", "file").write.mode("append").partitionBy("file").parquet(bronze)
    loads.refresh_flights(t.spark, bronze, silver)
    return scan.parquet(t.spark, silver).drop("FactID")


@query("SELECT * FROM airports", "airports")
def airports_refresh_without_input(t):
    """A full refresh from a folder without a matching file leaves the table as it was."""
    silver, empty = fresh(t, "silver-airports"), fresh(t, "bronze-empty")
    loads.refresh_dimension(airport_dim(t.airports), None, silver, "AirportID")
    t.airport_codes.write.parquet(f"{empty}/a_notes.parquet")
    if loads.refresh_airports(t.spark, empty, silver, full=True) or loads.refresh_aircraft(t.spark, empty, silver, full=True):
        raise AssertionError("something was read")
    return scan.parquet(t.spark, silver)


@query(
    """SELECT CAST(ym // 100 AS INT) AS year_partition, CAST(ym % 100 AS INT) AS month_partition, n AS rows_written,
 CAST(sum(n) OVER (PARTITION BY ym > 199806) AS BIGINT) AS total_read, CAST(sum(n) OVER (PARTITION BY ym > 199806) AS BIGINT) AS total_written, CAST(0 AS BIGINT) AS total_rejected, true AS verified
 FROM (SELECT BEGIN_YEARMONTH AS ym, count(*) AS n FROM fx_weather GROUP BY ALL)""",
    "fx_weather",
)
def audits_of_two_loads(t):
    """Two storm loads into one table: each audit looks at its own months only."""
    bronze = fresh(t, "storm-bronze")
    storms = t.weather.withColumn("YEAR", F.expr("BEGIN_YEARMONTH div 100"))
    parts = [storms.filter("BEGIN_YEARMONTH <= 199806"), storms.filter("BEGIN_YEARMONTH > 199806")]
    return union_all([sink.split_by_month(part, bronze, "YEAR", "BEGIN_YEARMONTH") for part in parts])


@query(
    "SELECT CAST(d AS DATE) AS snapshot_date, count(*) AS rows_read, count(*) AS rows_written, true AS verified FROM fx_aircraft, (VALUES ('2024-05-01'), ('2024-06-01')) v(d) GROUP BY d",
    "fx_aircraft",
)
def registry_audits(t):
    csv, bronze = fresh(t, "registry-csv"), fresh(t, "registry-bronze")
    raw = t.aircraft.toDF("N-NUMBER", "MFR", "MODEL", "TYPE AIRCRAFT", "TYPE ENGINE", "YEAR MFR")
    raw.write.options(header=True, quote='"', escape="\\").csv(csv)
    return union_all([loads.load_registry_bronze(t.spark, csv, bronze, day) for day in ("2024-05-01", "2024-06-01")])


@query("SELECT N_NUMBER, true AS today FROM fx_aircraft", "fx_aircraft")
def snapshot_of_today(t):
    """A dated copy without a given date has the current one."""
    path = fresh(t, "snapshots")
    before = t.spark.range(1).select(F.current_date()).first()[0]
    sink.write_dated_snapshot(t.aircraft.select("N_NUMBER"), path)
    today = F.col("snapshot_date").between(F.lit(before), F.current_date())
    return scan.parquet(t.spark, path).select(F.col("N_NUMBER").cast("string").alias("N_NUMBER"), today.alias("today"))


@query("SELECT count(*) AS n, count(*) AS ids FROM fx_flights", "fx_flights")
def fact_keys_over_loads(t):
    """Two loads: (year, month, FactID) tells all rows apart, since a month is written by one load only."""
    bronze, silver = bronze_flights(t), fresh(t, "silver-flights")
    loads.refresh_flights(t.spark, bronze, silver, only=[(1998, m) for m in range(1, 13)])
    loads.refresh_flights(t.spark, bronze, silver)
    return scan.parquet(t.spark, silver).agg(F.count("*").alias("n"), F.count_distinct(*PERIOD, "FactID").alias("ids"))


def drop_databases(spark) -> None:
    """Drop the databases that queries have made; for the end of a session, with ``clear_scratch``."""
    for name in [d.name for d in spark.catalog.listDatabases() if d.name.startswith(CHECKS)]:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def database(t) -> str:
    name = f"{CHECKS}{uuid.uuid4().hex}"
    catalog.create_database(t.spark, name)
    return name


def through_table(t, table: str, df):
    """``df`` as a stored table, read through an external catalog table of its own database."""
    path, (_, monthly) = fresh(t, f"table-{table}"), catalog.SILVER_TABLES[table]
    sink.overwrite_periods(df, path, rebalance=True) if monthly else sink.write_snapshot(df, path)
    name = catalog.create_silver(t.spark, table, path, database(t))
    catalog.refresh(t.spark, name, monthly=monthly)
    return t.spark.table(name)


@query("SELECT * FROM months_of_flights", "months_of_flights")
def flights_through_table(t):
    return months_of(through_table(t, "flight_facts", facts(t)))


@query("SELECT * FROM facts", "facts")
def flight_rows_through_table(t):
    """Whole rows, where ``flights_through_table`` has a count and a sum."""
    return through_table(t, "flight_facts", facts(t)).drop("FactID")


@query("SELECT * FROM airports", "airports")
def airports_through_table(t):
    return through_table(t, "airport_dim", airport_dim(t.airports))


@query("SELECT * FROM aircraft", "aircraft")
def aircraft_through_table(t):
    return through_table(t, "aircraft_dim", aircraft_dim(t.aircraft))


@query(NEAR, "events_near")
def weather_through_table(t):
    month = F.col("BEGIN_DATETIME")
    dated = storms_near_airports(dated_storms(t), t.airports).drop(*PERIOD).withColumns({PERIOD[0]: F.year(month), PERIOD[1]: F.month(month)})
    return rounded(through_table(t, "weather_airport_events", dated).drop(*PERIOD))


@query("SELECT * FROM delay_airport", "delay_airport")
def view_served_after_two_loads(t):
    """Months of two loads are both in the served view: tables are refreshed by the loads and before serving."""
    bronze, home, base = bronze_flights(t), fresh(t, "silver"), database(t)
    for table, (_, monthly) in catalog.SILVER_TABLES.items():
        if table in ("flight_facts", "airport_dim"):
            catalog.create_silver(t.spark, table, f"{home}/{table}", base)
    sink.write_snapshot(airport_dim(t.airports), f"{home}/airport_dim")
    loads.refresh_flights(t.spark, bronze, f"{home}/flight_facts", only=[(1998, m) for m in range(1, 13)], table=f"{base}.flight_facts")
    loads.refresh_flights(t.spark, bronze, f"{home}/flight_facts")
    loads.serve(t.spark, fresh(t, "kv"), silver=base, serving=f"{base}_serving")
    return t.spark.table(f"{base}_serving.delay_airport_month")


@query(
    """SELECT EVENT_ID, AIRPORT_ID, round(km, 3) AS km FROM (SELECT EVENT_ID, AIRPORT_ID, 6371 * 2 * asin(least(1, sqrt(
  pow(sin(radians((s.lat - p.lat) / 2)), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians((s.lon - p.lon) / 2)), 2)))) AS km
 FROM (SELECT EVENT_ID, CAST(87 + (EVENT_ID % 30) / 10.0 AS DOUBLE) AS lat, BEGIN_LON AS lon FROM fx_weather) p
 CROSS JOIN (SELECT AIRPORT_ID, CAST(88 + (AIRPORT_ID % 20) / 10.0 AS DOUBLE) AS lat, LONGITUDE AS lon FROM fx_airports) s) WHERE km <= 50""",
    "fx_weather",
    "fx_airports",
)
def polar_sites(t):
    """Sites near the pole, where a circle touches very many squares of the grid."""
    points = t.weather.select("EVENT_ID", F.expr("CAST(87 + (EVENT_ID % 30) / 10.0 AS DOUBLE)").alias("plat"), F.col("BEGIN_LON").alias("plon"))
    sites = t.airports.select("AIRPORT_ID", F.expr("CAST(88 + (AIRPORT_ID % 20) / 10.0 AS DOUBLE)").alias("slat"), F.col("LONGITUDE").alias("slon"))
    pairs = within_radius(points, sites, 50, point=("plat", "plon"), site=("slat", "slon"), max_broadcast_sites=1000)
    return pairs.select("EVENT_ID", "AIRPORT_ID", rounded_value(F.col("DISTANCE_KM"), 3).alias("km"))
