"""Views that are kept up by month equal those built anew, and read only what has changed."""

import glob
import pathlib
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import values
from flightlens import fixtures
from flightlens.plans import serving, upkeep, views
from flightlens.plans.dimensions import aircraft_dim, airport_dim
from flightlens.plans.flights import flight_facts
from flightlens.registry.incoming import database, drop_databases
from flightlens.registry.query import Tables
from flightlens.schemas import PERIOD
from flightlens.sources import catalog, listing, scan, sink

SF = "/root/testdata/sf0.001"
DELAY = "delay_airport_month"


class Store:
    """Silver tables in a database of their own, and what is kept up from them."""

    def __init__(self, spark, path, tables=tuple(catalog.SILVER_TABLES)):
        self.spark, self.path, self.base = spark, path, f"upkeep_{uuid.uuid4().hex}"
        catalog.create_database(spark, self.base)
        for table in tables:
            catalog.create_silver(spark, table, f"{path}/{table}", self.base)

    def put(self, table, df, months=None):
        if months is None:
            sink.write_snapshot(df, f"{self.path}/{table}")
        else:
            sink.replace_periods(df.filter(upkeep.among(months, PERIOD)), f"{self.path}/{table}", months, rebalance=True)

    def keep_up(self):
        return upkeep.keep_up(self.spark, f"{self.path}/home", silver=self.base, serving=f"{self.base}_kept")

    def kept(self, name):
        return self.spark.table(f"{self.base}_kept.{name}")


@pytest.fixture
def raw(spark):
    table = {name: fixtures.load(spark, SF, f"fx_{name}") for name in ("flights", "airports", "aircraft")}
    flights = flight_facts(table["flights"]).filter("year_partition IN (1997, 1998) AND month_partition <= 3")
    airports = airport_dim(table["airports"])
    storms = airports.select(F.col("AirportID").alias("AIRPORT_ID"), F.explode(F.array(*[F.lit(m) for m in (1, 2, 3)])).alias("month_partition"))
    storms = storms.withColumns({"EVENT_TYPE": F.when(F.expr("AIRPORT_ID % 2 = 0"), "Hail").otherwise("Tornado"), "year_partition": F.lit(1998)})
    columns = [f for f in spark.createDataFrame([], catalog.SILVER_TABLES["weather_airport_events"][0]).schema if f.name not in storms.columns]
    storms = storms.withColumns({f.name: F.lit(None).cast(f.dataType) for f in columns})
    return {"flight_facts": flights, "airport_dim": airports, "aircraft_dim": aircraft_dim(table["aircraft"]), "weather_airport_events": storms}


MONTHS = [(y, m) for y in (1997, 1998) for m in (1, 2, 3)]


def rounded(df):
    return values(df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in sorted(df.dtypes)]))


def test_turns_of_loads(spark, raw, tmp_path):
    store = Store(spark, str(tmp_path))
    wrong = raw["flight_facts"].withColumn("DepartureDelay", F.lit(7))
    store.put("airport_dim", raw["airport_dim"])
    store.put("aircraft_dim", raw["aircraft_dim"].withColumn("YearManufactured", F.lit(1990)))
    store.put("flight_facts", raw["flight_facts"], MONTHS[:4])
    store.put("flight_facts", wrong, [(1998, 2)])
    store.put("weather_airport_events", raw["weather_airport_events"], [(1998, 1)])
    first = store.keep_up()
    assert first["stats/airport_carrier_month"] == [*MONTHS[:4], (1998, 2)]
    assert store.keep_up() == {}

    # What has not changed cannot be read any more.
    for month in MONTHS[:4]:
        for name in glob.glob(f"{tmp_path}/flight_facts/year_partition={month[0]}/month_partition={month[1]}/*.parquet"):
            pathlib.Path(name).write_bytes(b"gone")
            pathlib.Path(name).parent.joinpath(f".{pathlib.Path(name).name}.crc").unlink(missing_ok=True)
    store.put("flight_facts", raw["flight_facts"], [(1998, 2), (1998, 3)])
    second = store.keep_up()
    assert second[f"views/{DELAY}"] == second["kv/top10_airports_delay_month"] == [(1998, 2), (1998, 3)]
    assert second["views/aircraft_age_bucket_carrier_year"] == [(1998,)]

    # Other tables: only the views that depend on them, from stored statistics.
    store.put("weather_airport_events", raw["weather_airport_events"], [(1998, 3)])
    third = store.keep_up()
    assert {name for name in third if name.startswith("views/")} == {"views/delay_weather_region_month", "views/cancel_weather_region_month"}
    assert third["views/delay_weather_region_month"] == [(1998, 3)]
    store.put("aircraft_dim", raw["aircraft_dim"])
    fourth = store.keep_up()
    assert fourth == {"views/aircraft_age_bucket_carrier_year": [(1997,), (1998,)], "kv/aircraft_age_bucket_carrier_year": [(1997,), (1998,)]}
    store.put("airport_dim", raw["airport_dim"].withColumn("AirportStateName", F.concat(F.lit("new "), "AirportStateName")))
    assert store.keep_up()["views/cancel_weather_region_month"] == MONTHS

    weather = raw["weather_airport_events"].filter("month_partition <> 2")
    regions = raw["airport_dim"].withColumn("AirportStateName", F.concat(F.lit("new "), "AirportStateName"))
    want = views.build_views(raw["flight_facts"], regions, weather, raw["aircraft_dim"])
    for name, view in want.items():
        assert rounded(store.kept(name)) == rounded(view), name
        keyed = scan.parquet(spark, f"{tmp_path}/home/kv/{name}")
        assert values(keyed.select("rowkey")) == values(serving.keyed_view(name, view).select("rowkey")), name


def test_a_month_that_is_gone_is_gone_from_the_views(spark, raw, tmp_path):
    store = Store(spark, str(tmp_path), ("flight_facts", "airport_dim"))
    store.put("airport_dim", raw["airport_dim"])
    store.put("flight_facts", raw["flight_facts"], MONTHS[:2])
    store.keep_up()
    store.put("flight_facts", raw["flight_facts"].limit(0), [MONTHS[0]])
    assert store.keep_up()[f"views/{DELAY}"] == [MONTHS[0]]
    assert values(store.kept(DELAY).select(*PERIOD).distinct()) == [MONTHS[1]]


def test_a_run_that_dies_is_repeated(spark, raw, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), ("flight_facts", "airport_dim"))
    store.put("airport_dim", raw["airport_dim"])
    store.put("flight_facts", raw["flight_facts"], MONTHS[:2])
    monkeypatch.setattr(upkeep.Home, "note", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.keep_up()
    monkeypatch.undo()
    assert store.keep_up()[f"views/{DELAY}"] == MONTHS[:2]
    with pytest.raises(ValueError):
        upkeep.keep_up(spark, str(tmp_path / "other"), silver="no_such")


def test_an_absent_key_reads_no_row_group(spark, rows, tmp_path):
    """Bloom filters on keys: minimum and maximum alone would read the file."""
    keyed = rows("rowkey string, cells map<string,string>, year_partition int, month_partition int", *[(f"{k}#199801", {"a": "1"}, 1998, 1) for k in range(0, 20_000, 2)])
    path = str(tmp_path / "kv")
    sink.replace_periods(keyed.coalesce(1), path, [(1998, 1)], sort=["rowkey"], bloom=["rowkey"])

    def rows_read(key):
        df = scan.parquet(spark, path).filter(F.col("rowkey") == key)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        return plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    assert rows_read("1002#199801") > 0
    assert sum(rows_read(f"{k}#199801") > 0 for k in range(1001, 1041, 2)) <= 2


def test_lookups_read_the_partitions_of_their_range_only(spark, rows, tmp_path):
    keyed = rows("rowkey string, cells map<string,string>, year_partition int, month_partition int", *[(f"7#{y}{m:02d}", {"v": f"{m}"}, y, m) for y in (1997, 1998) for m in range(1, 7)])
    path = str(tmp_path / "kv")
    sink.replace_periods(keyed, path, [(y, m) for y in (1997, 1998) for m in range(1, 7)], rebalance=True)
    series = serving.month_series(scan.parquet(spark, path), "7", 1998, 2, 3, ["v"])
    assert values(series) == [(1998, 2, 2.0), (1998, 3, 3.0)]
    plan = series._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_partition" in plan


def test_versions_of_months_need_no_file_to_be_opened(spark, rows, tmp_path):
    path = str(tmp_path / "monthly")
    sink.replace_periods(rows("v int, year_partition int, month_partition int", (1, 2024, 1), (2, 2024, 2)), path, [(2024, 1), (2024, 2)])
    df = spark.read.schema("v int").parquet(path)
    before = upkeep.month_versions(df)
    assert sorted(before) == ["2024-1", "2024-2"] and len(listing.files_of(df)) >= 2
    sink.replace_periods(rows("v int, year_partition int, month_partition int", (9, 2024, 2)), path, [(2024, 2)])
    after = upkeep.month_versions(spark.read.schema("v int").parquet(path))
    assert upkeep.changed(after, before) == {(2024, 2)}


def test_databases_of_queries_are_dropped(spark):
    names = [database(Tables(spark, SF)) for _ in range(2)]
    drop_databases(spark)
    assert not {d.name for d in spark.catalog.listDatabases()} & set(names)
