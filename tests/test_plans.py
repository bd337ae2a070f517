"""Physical plans: what must and must not appear in them."""

import re

import pytest
from pyspark.sql import functions as F

from flightlens import fixtures
from flightlens.plans import serving, storms, views
from flightlens.plans.flights import flight_facts
from flightlens.plans.storms import aligned_storms, storms_near_airports
from flightlens.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Facts, raw flights, storms and airports as Parquet, so that scans can be inspected."""
    root = tmp_path_factory.mktemp("plans")
    out = {}
    for name in ("fx_flights", "fx_weather", "fx_airports"):
        fixtures.load(spark, SF, name).write.parquet(str(root / name))
        out[name] = spark.read.parquet(str(root / name))
    flight_facts(out["fx_flights"]).write.partitionBy("year_partition", "month_partition").parquet(str(root / "facts"))
    out["facts"] = spark.read.parquet(str(root / "facts"))
    return out


def test_facts_need_no_shuffle(stored):
    assert "Exchange" not in plan(flight_facts(stored["fx_flights"]))


def test_views_read_only_their_columns_and_shuffle_once(stored):
    text = plan(views.delay_airport_month(stored["facts"]))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert schema == "DepartureAirportID:int,DepartureDelay:int,ArrivalDelay:int"
    assert text.count("Exchange") == 1 and "partial_sum" in text
    assert "IsNotNull(DepartureAirportID)" in text


def test_month_filter_prunes_partitions(stored):
    text = plan(views.delay_carrier_month(stored["facts"].filter("year_partition = 1998 AND month_partition = 3")))
    assert re.search(r"PartitionFilters: \[[^\]]*year_partition[^\]]* = 1998", text)


def test_storm_filters_reach_the_scan(stored):
    text = plan(aligned_storms(stored["fx_weather"]))
    pushed = text[text.index("PushedFilters") :]
    for name in ("BEGIN_LAT", "BEGIN_LON", "END_LAT", "END_LON"):
        assert f"IsNotNull({name})" in pushed
    assert "In(EVENT_TYPE" in pushed


@pytest.mark.parametrize("few", [True, False])
def test_distance_join_is_an_equi_join(spark, stored, few):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        limit = {} if few else {"max_broadcast_sites": 0}
        text = plan(storms_near_airports(aligned_storms(stored["fx_weather"]), stored["fx_airports"], **limit))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert ("BroadcastHashJoin" if few else "_salt") in text
    assert few or "SortMergeJoin" in text or "ShuffledHashJoin" in text


def test_top_airports_limit_before_the_shuffle(stored):
    text = plan(views.top_airports_month(views.delay_airport_month(stored["facts"])))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert text.count("Exchange hashpartitioning") == 2  # the aggregate and the ranking; none for the wide rows


@pytest.mark.parametrize("name", ["delay_weather_region_month", "aircraft_age_view", "kv_scan_all_regions", "storm_airport_join", "top10_labeled"])
def test_no_python_and_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("Python", "BatchEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_hot_airport_sends_one_row_per_task(spark):
    flights = spark.range(0, 100_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(7).cast("int").alias("DepartureAirportID"),
        F.lit(2024).alias("year_partition"),
        F.lit(1).alias("month_partition"),
        F.lit(5).alias("DepartureDelay"),
        F.lit(5).alias("ArrivalDelay"),
        F.lit(False).alias("IsCancelledFlag"),
    )
    text = plan(views.delay_airport_month(flights))
    partial, exchange = text.index("partial_sum"), text.index("Exchange hashpartitioning")
    assert exchange < partial  # printed from the top: rows are combined below the exchange
    view = views.delay_airport_month(flights)
    view.collect()
    assert 0 < rows_shuffled(view) <= 8 * 50  # airports in a task, not flights


def rows_shuffled(df) -> int:
    """Rows that the executed plan's exchanges have written."""
    found = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


def test_storms_are_never_dealt_to_fewer_tasks(spark):
    few = spark.range(0, 100, 1, 2).select("id")
    many = spark.range(0, 100, 1, 40).select("id")
    assert storms.dealt_out(few, 8).rdd.getNumPartitions() == 8
    assert storms.dealt_out(many, 3).rdd.getNumPartitions() == 40
    assert storms.dealt_out(few, 0).rdd.getNumPartitions() == 2


def test_age_rows_read_their_input_once(spark):
    keyed = spark.range(5).select(F.concat(F.lit("1998#0-5#C"), "id").alias("rowkey"), F.create_map(F.lit("flights_cnt"), F.col("id").cast("string")).alias("cells"))
    assert plan(serving.age_rows(keyed, 1998, top_carriers=2)).count("Range (") == 1
    assert [r.carrier for r in serving.age_rows(keyed, 1998, top_carriers=2).collect()] == ["C3", "C4"]
