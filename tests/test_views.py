"""Views: ties, missing regions, ages, joint building, and counts that must add up."""

import pytest
from pyspark.sql import functions as F

from flightlens import fixtures
from flightlens.plans import views
from flightlens.plans.dimensions import aircraft_dim, airport_dim
from flightlens.plans.flights import flight_facts, normalized_flights
from flightlens.plans.storms import aligned_storms, storms_near_airports
from flightlens.session import materialize

from conftest import values

FACTS = (
    "DepartureAirportID int, ArrivalAirportID int, CarrierCode string, IsCancelledFlag boolean, DepartureDelay int,"
    "ArrivalDelay int, year_partition int, month_partition int, TailNumber string"
)


def fact(airport=1, carrier="AA", cancelled=False, dep=0, arr=0, year=2024, month=1, tail="N1"):
    return (airport, 9, carrier, cancelled, dep, arr, year, month, tail)


def test_delays_and_cancellations(rows):
    flights = rows(
        FACTS,
        fact(dep=10, arr=20),
        fact(dep=0, arr=None, cancelled=True),
        fact(dep=5, arr=10, cancelled=None),
        fact(airport=None),
        fact(month=None),
    )
    assert values(views.delay_airport_month(flights)) == [("1", 2024, 1, 5.0, 15.0, 3)]
    assert values(views.cancel_airport_month(flights)) == [("1", 2024, 1, 1, 3, 33.333)]
    assert values(views.delay_carrier_month(flights)) == [("AA", 2024, 1, 5.0, 15.0, 3)]


def test_views_accept_normalized_flights(rows):
    flights = rows(FACTS, fact(dep=10), fact(airport=2, dep=3))
    normal = normalized_flights(flights)
    assert dict(normal.dtypes)["DepartureAirportID"] == "string"
    assert values(views.delay_airport_month(normal)) == values(views.delay_airport_month(flights))


def test_top_airports_ties_and_short_months(rows):
    schema = "DepartureAirportID string, year_partition int, month_partition int, avg_dep_delay double"
    tied = [(str(i), 2024, 1, 50.0 - i if i < 10 else 41.0) for i in range(1, 13)]
    data = [*tied, ("8", 2024, 2, None), ("7", 2024, 2, 1.0)]
    out = {r.month_partition: r for r in views.top_airports_month(rows(schema, *data)).collect()}
    assert [out[1][f"rank{i:02d}_airport"] for i in range(1, 11)] == ["1", "2", "3", "4", "5", "6", "7", "8", "10", "11"]
    assert [out[1][f"rank{i:02d}_delay"] for i in (1, 8, 9, 10)] == [49.0, 42.0, 41.0, 41.0]
    assert (out[2].rank01_airport, out[2].rank01_delay, out[2].rank02_airport, out[2].rank02_delay) == ("7", 1.0, "8", None)
    assert out[2].rank03_airport is None and out[2].rank10_delay is None


WEATHER = "AIRPORT_ID int, EVENT_TYPE string, year_partition int, month_partition int, HOUR_OFFSET int"


def test_weather_counts_a_flight_once_per_event_type(rows):
    flights = rows(FACTS, fact(dep=10, cancelled=True), fact(dep=20, cancelled=None), fact(airport=2, dep=30), fact(month=2, dep=99))
    airports = rows("AirportID int, AirportStateName string", (1, "Texas"))
    weather = rows(WEATHER, (1, "Hail", 2024, 1, 0), (1, "Hail", 2024, 1, 1), (1, "Fog", 2024, 1, 0), (2, "Hail", 2024, 1, 0), (1, None, 2024, 1, 0))
    delay = views.delay_weather_region_month(flights, airports, weather)
    assert values(delay.drop("avg_arr_delay")) == [
        ("Texas", "Fog", 2024, 1, 15.0, 2),
        ("Texas", "Hail", 2024, 1, 15.0, 2),
        (None, "Hail", 2024, 1, 30.0, 1),
    ]
    inner = views.delay_weather_region_month(flights, airports, weather, region_join="inner")
    assert {r.Region for r in inner.collect()} == {"Texas"}
    cancel = views.cancel_weather_region_month(flights, airports, weather)
    assert values(cancel)[0] == ("Texas", "Fog", 2024, 1, 1.0, 2)  # the missing flag is left out of the rate


def test_aircraft_ages(rows):
    flights = rows(FACTS, *[fact(tail=f"N{i}", dep=i) for i in range(9)], fact(tail=None), fact(carrier=None), fact(tail="N99"))
    built = [2024, 2019, 2018, 2014, 2013, 2004, 2003, 2025, None]
    aircraft = rows("TailNum string, YearManufactured int", *[(f"N{i}", y) for i, y in enumerate(built)])
    out = views.aircraft_age_bucket_carrier_year(flights, aircraft)
    assert {(r.aircraft_age_bucket, r.flights_cnt) for r in out.collect()} == {
        ("0-5", 2), ("6-10", 2), ("11-20", 2), (">20", 1), ("unknown", 1),
    }
    shuffled = views.aircraft_age_bucket_carrier_year(flights, aircraft, max_broadcast_aircraft=0)
    assert values(shuffled) == values(out)
    kept = views.aircraft_age_bucket_carrier_year(flights, aircraft, keep_unknown_year=True)
    assert {(r.aircraft_age_bucket, r.flights_cnt) for r in kept.collect()} >= {("unknown", 2)}


def test_missing_optional_tables_give_no_view(rows):
    flights, airports = rows(FACTS, fact()), rows("AirportID int, AirportStateName string", (1, "Texas"))
    assert views.delay_weather_region_month(flights, airports, None) is None
    assert views.cancel_weather_region_month(flights, airports, None) is None
    assert views.aircraft_age_bucket_carrier_year(flights, None) is None
    assert set(views.build_views(flights, airports)) == {
        "delay_airport_month", "cancel_airport_month", "delay_carrier_month", "top10_airports_delay_month",
    }
    with pytest.raises(ValueError, match="airport_dim lacks columns"):
        views.delay_weather_region_month(flights, airports.drop("AirportID"), rows(WEATHER, (1, "Hail", 2024, 1, 0)))


@pytest.fixture(scope="module")
def domain(spark):
    raw = {n: fixtures.load(spark, "/root/testdata/sf0.001", n) for n in fixtures.SQL}
    months = raw["fx_weather"].withColumns(
        {"year_partition": F.expr("BEGIN_YEARMONTH div 100"), "month_partition": F.expr("BEGIN_YEARMONTH % 100")}
    )
    weather = storms_near_airports(aligned_storms(months), raw["fx_airports"], 200)
    return flight_facts(raw["fx_flights"]), airport_dim(raw["fx_airports"]), weather, aircraft_dim(raw["fx_aircraft"])


def test_joint_building_equals_single_views(domain):
    flights, airports, weather, aircraft = domain
    joint = views.build_views(flights, airports, weather, aircraft, shared=materialize)
    assert set(joint) == set(views.VIEWS)
    delays = views.delay_airport_month(flights)
    single = {
        "delay_airport_month": delays,
        "cancel_airport_month": views.cancel_airport_month(flights),
        "delay_carrier_month": views.delay_carrier_month(flights),
        "top10_airports_delay_month": views.top_airports_month(delays),
        "delay_weather_region_month": views.delay_weather_region_month(flights, airports, weather),
        "cancel_weather_region_month": views.cancel_weather_region_month(flights, airports, weather),
        "aircraft_age_bucket_carrier_year": views.aircraft_age_bucket_carrier_year(flights, aircraft),
    }
    for name, view in single.items():
        assert joint[name].dtypes == view.dtypes, name
        assert values(joint[name]) == values(view), name
        assert view.columns == [*views.VIEWS[name].grain, *views.VIEWS[name].measures], name


def test_counts_add_up(domain):
    flights, airports, weather, aircraft = domain
    total = flights.count()
    summed = lambda df: df.agg(F.sum("flights_cnt")).collect()[0][0]
    assert summed(views.delay_airport_month(flights)) == total
    assert summed(views.delay_carrier_month(flights)) == total
    assert summed(views.aircraft_age_bucket_carrier_year(flights, aircraft)) <= total
    one_event = views.delay_weather_region_month(flights, airports, weather.filter("EVENT_TYPE = 'Hail'"))
    assert summed(one_event) <= total


def test_facts_from_untyped_text(rows):
    columns = "ORIGIN_AIRPORT_ID DEST_AIRPORT_ID OP_CARRIER CANCELLED CANCELLATION_CODE CRS_DEP_TIME DEP_DELAY DEP_TIME_BLK CRS_ARR_TIME ARR_DELAY ARR_TIME_BLK DIVERTED TAIL_NUM YEAR MONTH".split()
    schema = ", ".join(f"{c} string" for c in columns)
    raw = rows(schema, ("12478", "x", "AA", "1.00", "B", "0905", None, "0900-0959", "2400", "", "2300-2359", "0.00", "N1", "2024", "3"))
    out = flight_facts(raw).drop("FactID")
    assert values(out) == [(12478, None, "AA", True, "Weather", "09:05:00", 0, "0900-0959", None, None, "2300-2359", False, "N1", 2024, 3)]
