"""The seven serving views, declared as data.

Each view is a grain and a list of measures over flight statistics. V1-V6 come from
statistics per airport, carrier and month, so building them together reads the flights
once; the aircraft view needs tail numbers and reads them a second time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.codes import AGE_BUCKETS, AGE_UNKNOWN
from flightlens.functions.values import bucket
from flightlens.operators.aggregate import collect_stats, finish, merge_stats, top_per_group
from flightlens.operators.checks import present, require_columns
from flightlens.operators.combine import fits
from flightlens.operators.reshape import ranks_to_columns
from flightlens.plans.flights import with_view_keys
from flightlens.schemas import PERIOD

AIRPORT, CARRIER, TAIL = "DepartureAirportID", "CarrierCode", "TailNumber"
# A tail number and a year take about 100 bytes in a broadcast table: 100 MB at most.
MAX_BROADCAST_AIRCRAFT = 1_000_000
DELAYS = ("avg_dep_delay", "avg_arr_delay", "flights_cnt")


@dataclass(frozen=True)
class View:
    name: str
    grain: tuple[str, ...]
    measures: tuple[str, ...]


DELAY_AIRPORT = View("delay_airport_month", (AIRPORT, *PERIOD), DELAYS)
CANCEL_AIRPORT = View("cancel_airport_month", (AIRPORT, *PERIOD), ("cancel_cnt", "flights_cnt", "cancel_pct"))
DELAY_CARRIER = View("delay_carrier_month", (CARRIER, *PERIOD), DELAYS)
DELAY_WEATHER = View("delay_weather_region_month", ("Region", "EventType", *PERIOD), DELAYS)
CANCEL_WEATHER = View("cancel_weather_region_month", ("Region", "EventType", *PERIOD), ("cancel_rate", "flights_cnt"))
AIRCRAFT_AGE = View("aircraft_age_bucket_carrier_year", ("flight_year", "aircraft_age_bucket", CARRIER), DELAYS)
TOP10 = View(
    "top10_airports_delay_month",
    tuple(PERIOD),
    tuple(f"rank{i:02d}_{what}" for i in range(1, 11) for what in ("airport", "delay")),
)
VIEWS = {
    v.name: v
    for v in (DELAY_AIRPORT, CANCEL_AIRPORT, DELAY_CARRIER, TOP10, DELAY_WEATHER, CANCEL_WEATHER, AIRCRAFT_AGE)
}


def month_stats(flights: DataFrame, *by: str) -> DataFrame:
    """Mergeable statistics per month and the given columns. The airport is grouped in its
    stored type and becomes text afterwards, on the few aggregated rows."""
    stats = collect_stats(with_view_keys(flights), [*by, *PERIOD])
    return stats.withColumn(AIRPORT, F.col(AIRPORT).cast("string")) if AIRPORT in by else stats


def delay_airport_month(flights: DataFrame) -> DataFrame:
    return finish(month_stats(flights, AIRPORT), DELAY_AIRPORT.grain, DELAY_AIRPORT.measures)


def cancel_airport_month(flights: DataFrame) -> DataFrame:
    return finish(month_stats(flights, AIRPORT), CANCEL_AIRPORT.grain, CANCEL_AIRPORT.measures)


def delay_carrier_month(flights: DataFrame) -> DataFrame:
    return finish(month_stats(flights, CARRIER), DELAY_CARRIER.grain, DELAY_CARRIER.measures)


def top_airports_month(delays: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` airports with the largest average departure delay each month, one wide row
    per month. Ties go to the smaller airport identifier (compared as text)."""
    order = [F.col("avg_dep_delay").desc_nulls_last(), F.col(AIRPORT).asc()]
    ranked = top_per_group(delays, PERIOD, order, n)
    return ranks_to_columns(ranked, PERIOD, {"airport": AIRPORT, "delay": "avg_dep_delay"}, n)


def weather_keys(weather: DataFrame) -> DataFrame:
    """Distinct (airport, event type, month): however many storm hours an airport saw, its
    flights of the month count once per event type."""
    require_columns(weather, ["AIRPORT_ID", "EVENT_TYPE", *PERIOD], "weather_airport_events")
    names = ["AIRPORT_ID", "EVENT_TYPE", *PERIOD]
    keys = present(weather, *names).select(*names).distinct()
    return keys.select(
        F.col("AIRPORT_ID").cast("string").alias(AIRPORT),
        F.col("EVENT_TYPE").cast("string").alias("EventType"),
        *[F.col(p).cast("int").alias(p) for p in PERIOD],
    )


def weather_stats(airport_stats: DataFrame, airports: DataFrame, weather: DataFrame, region_join: str = "left") -> DataFrame:
    """Statistics per region, event type and month.

    Flights are aggregated to airport and month before the joins. The same flight
    counts under every event type of its airport and month, so rows do not add up over
    event types. With the left join an unlisted airport has a NULL region.
    """
    require_columns(airports, ["AirportID", "AirportStateName"], "airport_dim")
    regions = airports.select(
        F.col("AirportID").cast("string").alias(AIRPORT), F.col("AirportStateName").alias("Region")
    )
    exposed = airport_stats.join(weather_keys(weather), [AIRPORT, *PERIOD], "inner")
    return merge_stats(exposed.join(regions, AIRPORT, region_join), DELAY_WEATHER.grain)


def delay_weather_region_month(flights: DataFrame, airports: DataFrame, weather: DataFrame | None, region_join: str = "left") -> DataFrame | None:
    """None if there is no weather table."""
    if weather is None:
        return None
    stats = weather_stats(month_stats(flights, AIRPORT), airports, weather, region_join)
    return finish(stats, DELAY_WEATHER.grain, DELAY_WEATHER.measures)


def cancel_weather_region_month(flights: DataFrame, airports: DataFrame, weather: DataFrame | None, region_join: str = "left") -> DataFrame | None:
    """None if there is no weather table."""
    if weather is None:
        return None
    stats = weather_stats(month_stats(flights, AIRPORT), airports, weather, region_join)
    return finish(stats, CANCEL_WEATHER.grain, CANCEL_WEATHER.measures)


def aircraft_age_bucket_carrier_year(
    flights: DataFrame,
    aircraft: DataFrame | None,
    keep_unknown_year: bool = False,
    max_broadcast_aircraft: int = MAX_BROADCAST_AIRCRAFT,
    shared=lambda df, name: df,
) -> DataFrame | None:
    """Delays per year, aircraft age bucket and carrier; None if there is no aircraft table.

    A registry of ordinary size (it is counted) is broadcast, and flights are aggregated
    straight to the few result rows. A larger one is joined to flights aggregated per
    carrier, year and tail: a placeholder tail number on very many flights is one row per
    carrier and year by then. The registry is counted and joined: ``shared`` as in ``build_views`` stores what is
    needed of it in between.
    """
    if aircraft is None:
        return None
    keyed = present(with_view_keys(flights), CARRIER, TAIL).withColumnRenamed(PERIOD[0], "flight_year")
    built = shared(registered_years(aircraft, keep_unknown_year), "registered_years")
    if fits(built, max_broadcast_aircraft):
        stats = collect_stats(with_age(keyed, F.broadcast(built)), AIRCRAFT_AGE.grain)
    else:
        stats = age_stats(collect_stats(keyed, [CARRIER, "flight_year", TAIL]), built)
    return finish(stats, AIRCRAFT_AGE.grain, AIRCRAFT_AGE.measures)


def registered_years(aircraft: DataFrame, keep_unknown_year: bool = False) -> DataFrame:
    """Tail numbers with the year they were built."""
    require_columns(aircraft, ["TailNum", "YearManufactured"], "aircraft_dim")
    built = aircraft.select(F.col("TailNum").alias(TAIL), F.col("YearManufactured").cast("int").alias("_built"))
    return present(built, TAIL) if keep_unknown_year else present(built, TAIL, "_built")


def with_age(df: DataFrame, built: DataFrame) -> DataFrame:
    age = bucket(F.col("flight_year") - F.col("_built"), AGE_BUCKETS, AGE_UNKNOWN)
    return df.join(built, TAIL).withColumn("aircraft_age_bucket", age)


def age_stats(per_tail: DataFrame, built: DataFrame) -> DataFrame:
    """Statistics per carrier, year and tail number (or finer) → per year, age bucket and carrier."""
    return merge_stats(with_age(per_tail, built), AIRCRAFT_AGE.grain)


def build_views(
    flights: DataFrame,
    airports: DataFrame,
    weather: DataFrame | None = None,
    aircraft: DataFrame | None = None,
    *,
    shared=lambda df, name: df,
) -> dict[str, DataFrame]:
    """All views whose inputs exist, by name.

    ``shared(df, name)`` stores what several views use and returns it for reading, e.g.
    ``flightlens.session.materialize``; by default nothing is stored.
    """
    fine = shared(month_stats(flights, AIRPORT, CARRIER), "airport_carrier_month_stats")
    by_airport = shared(merge_stats(fine, DELAY_AIRPORT.grain), "airport_month_stats")
    delays = finish(by_airport, DELAY_AIRPORT.grain, DELAY_AIRPORT.measures)
    views = {
        DELAY_AIRPORT: delays,
        CANCEL_AIRPORT: finish(by_airport, CANCEL_AIRPORT.grain, CANCEL_AIRPORT.measures),
        DELAY_CARRIER: finish(merge_stats(fine, DELAY_CARRIER.grain), DELAY_CARRIER.grain, DELAY_CARRIER.measures),
        TOP10: top_airports_month(delays),
    }
    if weather is not None:
        exposed = shared(weather_stats(by_airport, airports, weather), "weather_region_month_stats")
        for view in (DELAY_WEATHER, CANCEL_WEATHER):
            views[view] = finish(exposed, view.grain, view.measures)
    if aircraft is not None:
        views[AIRCRAFT_AGE] = aircraft_age_bucket_carrier_year(flights, aircraft, shared=shared)
    return {view.name: df for view, df in views.items()}
