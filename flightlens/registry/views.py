"""The serving views."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightlens.functions.times import month_of
from flightlens.operators.combine import union_all
from flightlens.plans import views
from flightlens.plans.dimensions import aircraft_dim, airport_dim
from flightlens.plans.flights import flight_facts
from flightlens.plans.storms import aligned_storms, storms_near_airports
from flightlens.registry import storms  # noqa: F401 - the SQL below builds on its parts
from flightlens.registry.query import part, query
from flightlens.schemas import PERIOD
from flightlens.session import materialize

DELAYS = "avg(DepartureDelay) AS avg_dep_delay, avg(ArrivalDelay) AS avg_arr_delay, count(*) AS flights_cnt"
MONTH = "year_partition, month_partition"

part(
    "delay_airport",
    ("facts",),
    f"SELECT CAST(DepartureAirportID AS VARCHAR) AS DepartureAirportID, {MONTH}, {DELAYS} FROM facts GROUP BY ALL",
)
part(
    "cancel_airport",
    ("facts",),
    f"""SELECT CAST(DepartureAirportID AS VARCHAR) AS DepartureAirportID, {MONTH},
 CAST(sum(CASE WHEN IsCancelledFlag THEN 1 ELSE 0 END) AS BIGINT) AS cancel_cnt, count(*) AS flights_cnt,
 round(sum(CASE WHEN IsCancelledFlag THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 3) AS cancel_pct FROM facts GROUP BY ALL""",
)
part("delay_carrier", ("facts",), f"SELECT CarrierCode, {MONTH}, {DELAYS} FROM facts GROUP BY ALL")
part(
    "ranked",
    ("delay_airport",),
    f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {MONTH}
 ORDER BY avg_dep_delay DESC NULLS LAST, DepartureAirportID) AS INT) AS rank FROM delay_airport) WHERE rank <= 10""",
)
WIDE = ", ".join(
    f"max(CASE WHEN rank = {i} THEN DepartureAirportID END) AS rank{i:02d}_airport, "
    f"max(CASE WHEN rank = {i} THEN avg_dep_delay END) AS rank{i:02d}_delay"
    for i in range(1, 11)
)
# Weather keys here are those of the storm's own month (its file), read back through EVENT_ID.
part(
    "weather_months",
    ("events_near", "fx_weather"),
    """SELECT DISTINCT AIRPORT_ID, n.EVENT_TYPE, w.BEGIN_YEARMONTH // 100 AS y, w.BEGIN_YEARMONTH % 100 AS m
 FROM events_near n JOIN fx_weather w ON n.ORIGINAL_INDEX = w.EVENT_ID""",
)


def exposed(join: str) -> str:
    return f"""SELECT a.AirportStateName AS Region, w.EVENT_TYPE AS EventType, f.* FROM facts f
 JOIN weather_months w ON f.DepartureAirportID = w.AIRPORT_ID AND f.year_partition = w.y AND f.month_partition = w.m
 {join} JOIN airports a ON f.DepartureAirportID = a.AirportID"""


part("exposed", ("facts", "weather_months", "airports"), exposed("LEFT"))
part("exposed_inner", ("facts", "weather_months", "airports"), exposed("INNER"))
part(
    "delay_weather",
    ("exposed",),
    f"SELECT Region, EventType, {MONTH}, {DELAYS} FROM exposed GROUP BY ALL",
)
part(
    "cancel_weather",
    ("exposed",),
    f"""SELECT Region, EventType, {MONTH}, avg(CAST(IsCancelledFlag AS DOUBLE)) AS cancel_rate, count(*) AS flights_cnt
 FROM exposed GROUP BY ALL""",
)
AGE = """CASE WHEN age BETWEEN 0 AND 5 THEN '0-5' WHEN age BETWEEN 6 AND 10 THEN '6-10'
 WHEN age BETWEEN 11 AND 20 THEN '11-20' WHEN age > 20 THEN '>20' ELSE 'unknown' END"""


def aged(known: str) -> str:
    return f"""SELECT year_partition AS flight_year, {AGE} AS aircraft_age_bucket, CarrierCode, {DELAYS}
 FROM (SELECT f.*, f.year_partition - a.YearManufactured AS age FROM facts f JOIN aircraft a ON f.TailNumber = a.TailNum
 WHERE f.CarrierCode IS NOT NULL {known}) GROUP BY ALL"""


part("aircraft_age", ("facts", "aircraft"), aged("AND a.YearManufactured IS NOT NULL"))


def dated_storms(t):
    """Aligned storms, in the month they begin."""
    year = F.expr("BEGIN_YEARMONTH div 100").cast("int")
    months = dict(zip(PERIOD, (year, month_of(F.col("BEGIN_YEARMONTH"))), strict=True))
    return aligned_storms(t.weather.withColumns(months))


def weather(t):
    """Storm events near airports, in the month the storm begins: what the views need of them, each airport once with every event type and month."""
    return storms_near_airports(dated_storms(t), t.airports, once=["EVENT_TYPE", *PERIOD])


def facts(t):
    return flight_facts(t.flights)


@query("SELECT * FROM delay_airport", "delay_airport")
def delay_airport_month(t):
    return views.delay_airport_month(facts(t))


@query("SELECT * FROM cancel_airport", "cancel_airport")
def cancel_airport_month(t):
    return views.cancel_airport_month(facts(t))


@query("SELECT * FROM delay_carrier", "delay_carrier")
def delay_carrier_month(t):
    return views.delay_carrier_month(facts(t))


@query(f"SELECT {MONTH}, {WIDE} FROM ranked GROUP BY ALL", "ranked")
def top10_airports_month(t):
    return views.top_airports_month(views.delay_airport_month(facts(t)))


@query("SELECT * FROM delay_weather", "delay_weather")
def delay_weather_region_month(t):
    return views.delay_weather_region_month(facts(t), airport_dim(t.airports), weather(t))


@query("SELECT * FROM cancel_weather", "cancel_weather")
def cancel_weather_region_month(t):
    return views.cancel_weather_region_month(facts(t), airport_dim(t.airports), weather(t))


@query(
    f"""SELECT Region, EventType, {MONTH}, {DELAYS} FROM exposed_inner GROUP BY ALL""",
    "exposed_inner",
)
def delay_weather_region_inner(t):
    view = views.delay_weather_region_month(facts(t), airport_dim(t.airports), weather(t), region_join="inner")
    return view


@query(
    f"""SELECT Region, EventType, {MONTH}, {DELAYS} FROM
 (SELECT CASE WHEN c.AIRPORT_COUNTRY_NAME = 'United States' THEN e.Region END AS Region, e.* EXCLUDE (Region)
  FROM exposed e JOIN fx_airports c ON e.DepartureAirportID = c.AIRPORT_ID) GROUP BY ALL""",
    "exposed",
    "fx_airports",
)
def delay_weather_unlisted_airports(t):
    """Airports missing from the dimension: their flights have no region."""
    listed = airport_dim(t.airports.filter("AIRPORT_COUNTRY_NAME = 'United States'"))
    return views.delay_weather_region_month(facts(t), listed, weather(t))


@query(
    """SELECT DISTINCT CAST(AIRPORT_ID AS VARCHAR) AS DepartureAirportID, EVENT_TYPE AS EventType,
 CAST(y AS INT) AS year_partition, CAST(m AS INT) AS month_partition FROM weather_months""",
    "weather_months",
)
def weather_keys(t):
    return views.weather_keys(weather(t))


@query("SELECT * FROM aircraft_age", "aircraft_age")
def aircraft_age_view(t):
    return views.aircraft_age_bucket_carrier_year(facts(t), aircraft_dim(t.aircraft), shared=materialize)


@query("SELECT * FROM aircraft_age", "aircraft_age")
def aircraft_age_large_registry(t):
    """The plan for a registry too large to broadcast: same rows."""
    return views.aircraft_age_bucket_carrier_year(facts(t), aircraft_dim(t.aircraft), max_broadcast_aircraft=0)


@query(aged(""), "facts", "aircraft")
def aircraft_age_keep_unknown(t):
    """Aircraft without a manufacture year stay, in the bucket ``unknown``."""
    return views.aircraft_age_bucket_carrier_year(facts(t), aircraft_dim(t.aircraft), keep_unknown_year=True)


@query(
    f"""SELECT 'delay_airport_month' AS view_name, count(*) AS n, CAST(sum(flights_cnt) AS BIGINT) AS flights FROM delay_airport
 UNION ALL SELECT 'cancel_airport_month', count(*), CAST(sum(flights_cnt) AS BIGINT) FROM cancel_airport
 UNION ALL SELECT 'delay_carrier_month', count(*), CAST(sum(flights_cnt) AS BIGINT) FROM delay_carrier
 UNION ALL SELECT 'delay_weather_region_month', count(*), CAST(sum(flights_cnt) AS BIGINT) FROM delay_weather
 UNION ALL SELECT 'cancel_weather_region_month', count(*), CAST(sum(flights_cnt) AS BIGINT) FROM cancel_weather
 UNION ALL SELECT 'aircraft_age_bucket_carrier_year', count(*), CAST(sum(flights_cnt) AS BIGINT) FROM aircraft_age
 UNION ALL SELECT 'top10_airports_delay_month', count(DISTINCT year_partition * 100 + month_partition), count(*) FROM ranked""",
    "ranked",
    "delay_airport",
    "cancel_airport",
    "delay_carrier",
    "delay_weather",
    "cancel_weather",
    "aircraft_age",
)
def all_views_from_shared_stats(t):
    """Every view built together from stored statistics, summarised."""
    built = views.build_views(
        facts(t), airport_dim(t.airports), weather(t), aircraft_dim(t.aircraft), shared=materialize
    )

    def weight(df):
        """Flights; for the ranking, which has none, the places that are taken."""
        places = [c for c in df.columns if c.endswith("_airport")]
        return F.col("flights_cnt") if "flights_cnt" in df.columns else sum(F.col(c).isNotNull().cast("long") for c in places)

    return union_all(
        [
            df.agg(F.count("*").alias("n"), F.sum(weight(df)).alias("flights")).select(F.lit(name).alias("view_name"), "n", "flights")
            for name, df in built.items()
        ]
    )
