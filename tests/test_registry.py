"""Every registered query against its SQL in DuckDB."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, queries
from flightlens.registry import ORACLES, QUERIES, incoming
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    problem = compare(queries()[name](spark, SF), duck, ORACLES[name])
    assert problem in (None, "no rows")  # some lookups find nothing in the smallest tables


def test_entry(spark):
    assert entry(spark).columns == ["Region", "EventType", "year_partition", "month_partition", "avg_dep_delay", "avg_arr_delay", "flights_cnt"]


def test_a_wrong_column_of_the_flight_table_is_seen(spark, duck, monkeypatch):
    right = incoming.facts
    monkeypatch.setattr(incoming, "facts", lambda t: right(t).withColumn("DepartureTimeBlock", F.lit("wrong")))
    problems = {n: compare(queries()[n](spark, SF), duck, ORACLES[n]) for n in ("flights_through_table", "flight_rows_through_table")}
    assert [n for n, problem in problems.items() if problem] == ["flight_rows_through_table"]


def test_a_december_in_several_plain_files(spark, duck):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 5)
    try:
        problem = compare(queries()["weather_from_all_layouts"](spark, SF), duck, ORACLES["weather_from_all_layouts"])
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert problem is None
