"""The domain's raw tables, derived from the test tables by SQL that Spark and DuckDB
both run unchanged (documented in FIXTURES.md). Event names are fixed values of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "fx_flights": """
SELECT l_orderkey*10+l_linenumber AS FLIGHT_KEY, CAST(10000+l_suppkey AS INT) AS ORIGIN_AIRPORT_ID,
 CAST(10000+(l_suppkey+l_linenumber)%10 AS INT) AS DEST_AIRPORT_ID, concat('C',substr(o_orderpriority,1,1)) AS OP_CARRIER,
 CAST(CASE WHEN l_returnflag='R' AND l_linenumber=1 THEN 1 ELSE 0 END AS DOUBLE) AS CANCELLED,
 CASE WHEN l_returnflag='R' AND l_linenumber=1 THEN substr('ABCDX',CAST(l_suppkey%5+1 AS INT),1) END AS CANCELLATION_CODE,
 CASE WHEN l_quantity=50 THEN NULL ELSE CAST((l_orderkey%25)*100+l_partkey%60 AS INT) END AS CRS_DEP_TIME,
 CAST((l_orderkey%24)*100+l_suppkey%60 AS INT) AS CRS_ARR_TIME,
 concat('B',CAST(l_orderkey%24 AS VARCHAR(4))) AS DEP_TIME_BLK, concat('B',CAST(l_suppkey%24 AS VARCHAR(4))) AS ARR_TIME_BLK,
 CASE WHEN l_returnflag='R' AND l_linenumber=1 THEN NULL ELSE l_quantity*3-40 END AS DEP_DELAY,
 CASE WHEN (l_returnflag='R' AND l_linenumber=1) OR l_partkey%97=0 THEN NULL ELSE l_quantity*3-45+l_linenumber END AS ARR_DELAY,
 CAST(CASE WHEN l_partkey%97=0 THEN 1 ELSE 0 END AS DOUBLE) AS DIVERTED,
 CASE WHEN l_partkey%50=0 THEN NULL ELSE concat('N',CAST(l_partkey AS VARCHAR(20))) END AS TAIL_NUM,
 CAST(year(o_orderdate) AS INT) AS YEAR, CAST(month(o_orderdate) AS INT) AS MONTH
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey
""",
    "fx_airports": """
SELECT CAST(10000+s_suppkey AS INT) AS AIRPORT_ID, concat(' ',n_name,' ') AS AIRPORT_STATE_NAME, s_name AS DISPLAY_AIRPORT_NAME, concat(' City ',CAST(s_suppkey%40 AS VARCHAR(4))) AS DISPLAY_AIRPORT_CITY_NAME_FULL,
 CASE WHEN n_regionkey=4 THEN 'Canada' ELSE 'United States' END AS AIRPORT_COUNTRY_NAME,
 CAST(25+(s_suppkey*37%240)/10.0 AS DOUBLE) AS LATITUDE, CAST(-120+(s_suppkey*53%500)/10.0 AS DOUBLE) AS LONGITUDE
 FROM supplier JOIN nation ON s_nationkey=n_nationkey WHERE s_suppkey%10<>9
""",
    "fx_weather": """
SELECT event_id AS EVENT_ID, CAST((1995+event_id%7)*100+1+event_id%12 AS INT) AS BEGIN_YEARMONTH, CAST(1+event_id%26 AS INT) AS BEGIN_DAY,
 CAST((event_id%23)*100+(event_id%4)*15 AS INT) AS BEGIN_TIME, CAST((1995+event_id%7)*100+1+event_id%12 AS INT) AS END_YEARMONTH,
 CAST(1+event_id%26+event_id%3 AS INT) AS END_DAY, CAST((event_id*7%24)*100+(event_id%3)*20 AS INT) AS END_TIME,
 CASE event_id%16 WHEN 0 THEN 'Tornado'
   WHEN 1 THEN 'Funnel Cloud'
   WHEN 2 THEN 'Hail'
   WHEN 3 THEN 'Heavy Rain'
   WHEN 4 THEN 'Thunderstorm Wind'
   WHEN 5 THEN 'Hurricane'
   WHEN 6 THEN 'Marine Hurricane/Typhoon'
   WHEN 7 THEN 'Tropical Storm'
   WHEN 8 THEN 'Winter Storm'
   WHEN 9 THEN 'Blizzard'
   WHEN 10 THEN 'Heavy Snow'
   WHEN 11 THEN 'Ice Storm'
   WHEN 12 THEN 'Dust Storm'
   WHEN 13 THEN 'Dense Fog'
   WHEN 14 THEN 'Drought' ELSE 'Rip Current' END AS EVENT_TYPE,
 CASE WHEN event_id%41=0 THEN NULL ELSE CAST(25+(event_id*13%240)/10.0 AS DOUBLE) END AS BEGIN_LAT, CAST(-120+(event_id*29%500)/10.0 AS DOUBLE) AS BEGIN_LON,
 CAST(25+(event_id*13%240+event_id%5)/10.0 AS DOUBLE) AS END_LAT, CAST(-120+(event_id*29%500+event_id%7)/10.0 AS DOUBLE) AS END_LON FROM events
""",
    "fx_aircraft": """
SELECT CAST(p_partkey AS VARCHAR(20)) AS N_NUMBER, concat(' ',p_brand,' ') AS MFR, p_name AS MODEL, CAST(p_partkey%12 AS VARCHAR(4)) AS TYPE_AIRCRAFT, CAST(p_size%14 AS VARCHAR(4)) AS TYPE_ENGINE,
 CASE WHEN p_size=50 THEN '    ' ELSE CAST(1970+p_size AS VARCHAR(4)) END AS YEAR_MFR FROM part
""",
    "fx_airport_codes": """
SELECT CAST(10000+s_suppkey AS INT) AS AIRPORT_ID, concat('K',CAST(s_suppkey AS VARCHAR(8))) AS AIRPORT
 FROM supplier WHERE s_suppkey%4<>3
""",
}

SOURCES = {
    "fx_flights": ["lineitem", "orders"],
    "fx_airports": ["supplier", "nation"],
    "fx_weather": ["events"],
    "fx_aircraft": ["part"],
    "fx_airport_codes": ["supplier"],
}


# The second table of a join, from this size on, is hashed in shuffled partitions: the first and larger one is streamed past it, never sorted.
HASHED_BYTES = 2**23


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table over the whole test tables."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES[name]}
    tables |= {t: df.hint("shuffle_hash") for t, df in list(tables.items())[1:] if _bytes(df) >= HASHED_BYTES}
    query = SQL[name]
    for table in tables:
        query = query.replace(f"FROM {table}", f"FROM {{{table}}}").replace(f"JOIN {table}", f"JOIN {{{table}}}")
    return spark.sql(query, **tables)


def _bytes(df: DataFrame) -> int:
    """Size of a stored table by its plan; nothing is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
