"""Scans by file name, sinks, catalog tables and whole loads."""

import re

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from flightlens import fixtures, schemas
from flightlens.plans import loads
from flightlens.plans.dimensions import aircraft_dim
from flightlens.plans.flights import flight_facts
from flightlens.plans.views import VIEWS
from flightlens.schemas import PERIOD
from flightlens.sources import catalog, listing, scan, sink

from conftest import values

SF = "/root/testdata/sf0.001"


def files_read(df):
    """Number of files the scan opened."""
    df.collect()
    found = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().startswith("Scan"):
            found.append(node.metrics().apply("numFiles").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


@pytest.fixture
def bronze(spark, tmp_path):
    path = str(tmp_path / "flights")
    for year, month in [(2023, 12), (2024, 1), (2024, 10)]:
        spark.range(3).coalesce(1).write.parquet(f"{path}/{year}_{month}_aotd.parquet")
    spark.range(9).coalesce(1).write.parquet(f"{path}/notes.parquet")
    return path


def test_periods_from_names(spark, bronze, tmp_path):
    assert values(scan.bronze_periods(spark, bronze, scan.FLIGHT_FILES)) == [(2023, 12), (2024, 1), (2024, 10)]
    assert values(scan.bronze_periods(spark, str(tmp_path / "none"), scan.FLIGHT_FILES)) == []


def test_only_the_wanted_files_are_opened(spark, bronze):
    months = [m for m in scan.named_months(spark, bronze, scan.FLIGHT_FILES) if m[0] == 2024]
    with scan.month_frames(spark, bronze, months, scan.FLIGHT_FILES) as (df,):
        assert values(df.groupBy("year_partition", "month_partition").count()) == [(2024, 1, 3), (2024, 10, 3)]
        assert files_read(df) == 2
    assert files_read(scan.read_named(spark, bronze, "notes")) == 1
    with pytest.raises(FileNotFoundError):
        scan.read_named(spark, bronze, "nothing")


def test_months_as_partitions(spark, tmp_path):
    path = tmp_path / "it's raw"
    for month in (1, 2):
        spark.range(month).coalesce(1).write.parquet(f"{path}/2024_{month}_aotd.parquet")
    months = scan.named_months(spark, str(path), scan.FLIGHT_FILES)
    assert all(folder for *_, folder in months)
    before = {t.name for t in spark.catalog.listTables()}
    with scan.month_frames(spark, str(path), months, scan.FLIGHT_FILES) as (raw,):
        assert values(raw.groupBy("year_partition", "month_partition").count()) == [(2024, 1, 1), (2024, 2, 2)]
        assert files_read(raw.filter("month_partition = 2")) == 1
    assert {t.name for t in spark.catalog.listTables()} == before


def test_one_month_in_two_folders_and_a_file(spark, tmp_path):
    for name in ("2024_1_aotd.parquet", "2024_01_aotd.parquet"):
        spark.range(2).write.parquet(str(tmp_path / "raw" / name))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "x"))
    (tmp_path / "raw" / "v2_2024_1_aotd.parquet").write_bytes(next((tmp_path / "x").glob("part-*")).read_bytes())
    months = scan.named_months(spark, str(tmp_path / "raw"), scan.FLIGHT_FILES)
    with scan.month_frames(spark, str(tmp_path / "raw"), months, scan.FLIGHT_FILES) as frames:
        assert sum(df.filter("year_partition = 2024 AND month_partition = 1").count() for df in frames) == 9


def test_listing_starts_no_job_and_opens_no_leaf(spark, tmp_path, monkeypatch):
    for month in range(1, 6):
        spark.range(100).repartition(4).write.parquet(str(tmp_path / "raw" / f"2024_{month}_aotd.parquet"))
        spark.range(9).write.parquet(str(tmp_path / "silver" / "year_partition=2024" / f"month_partition={month}"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    found = listing.entries(spark, str(tmp_path))
    assert not tracker.getJobIdsForGroup("listing")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 10 and all(e.folder for e in found)
    assert [m[:2] for m in scan.partition_months(spark, str(tmp_path / "silver"))] == [(2024, m) for m in range(1, 6)]


def test_files_of_other_columns_and_types(spark, rows, tmp_path):
    path = str(tmp_path / "files")
    rows("id int, a string", (1, "x")).write.parquet(f"{path}/airport_1.parquet")
    rows("id string, b double", ("two", 2.5)).write.parquet(f"{path}/airport_2.parquet")
    rows("id bigint, b int", (3, 3)).write.parquet(f"{path}/airport_3.parquet")
    rows("other int", 9).write.parquet(f"{path}/a_notes.parquet")
    out = scan.read_named(spark, path, scan.AIRPORT_FILES)
    assert dict(out.dtypes) == {"id": "string", "a": "string", "b": "double"}
    assert values(out.select("id", "a", "b")) == [("1", "x", None), ("3", None, 3.0), ("two", None, 2.5)]


def test_a_bad_month_does_not_stop_the_others(spark, tmp_path):
    raw = fixtures.load(spark, SF, "fx_flights").filter("YEAR = 1998 AND MONTH IN (1, 2)")
    bronze, silver = tmp_path / "raw", str(tmp_path / "silver")
    for month in (1, 2):
        raw.filter(F.col("MONTH") == month).write.parquet(str(bronze / f"1998_{month}_aotd.parquet"))
    (bronze / "1998_3_aotd.parquet").write_bytes(b"not parquet")
    with pytest.raises(loads.MonthsFailed) as error:
        loads.refresh_flights(spark, str(bronze), silver)
    assert list(error.value.failed) == [(1998, 3)] and error.value.done == [(1998, 1), (1998, 2)]
    assert values(scan.stored_periods(spark, silver)) == [(1998, 1), (1998, 2)]


def test_months_without_rows_are_cleared_and_remembered(spark, rows, tmp_path):
    path, schema = str(tmp_path / "t"), "year_partition int, month_partition int, x int"
    sink.replace_periods(rows(schema, (2024, 1, 1), (2024, 2, 2)), path, [(2024, 1), (2024, 2), (2024, 3)])
    assert values(scan.processed_periods(spark, path)) == [(2024, 1), (2024, 2), (2024, 3)]
    assert sink.replace_periods(rows(schema, (2024, 2, 9)), path, [(2024, 1), (2024, 2)]) == [(2024, 1)]
    assert values(scan.parquet(spark, path).select("month_partition", "x")) == [(2, 9)]
    assert values(scan.stored_periods(spark, path)) == [(2024, 2)]
    assert values(scan.processed_periods(spark, path)) == [(2024, 1), (2024, 2), (2024, 3)]


@pytest.mark.parametrize("plain", [(), (2,), (1, 2)])
def test_flights_in_folders_and_plain_files(spark, tmp_path, plain):
    raw = fixtures.load(spark, SF, "fx_flights").filter("YEAR = 1998 AND MONTH IN (1, 2)")
    bronze, silver = tmp_path / "raw", str(tmp_path / "silver")
    for month in (1, 2):
        folder = bronze / f"1998_{month}_aotd.parquet"
        target = tmp_path / str(month) if month in plain else folder
        raw.filter(F.col("MONTH") == month).withColumn("MONTH", F.lit(9)).coalesce(1).write.parquet(str(target))
        if month in plain:
            bronze.mkdir(exist_ok=True)
            folder.write_bytes(next(target.glob("part-*.parquet")).read_bytes())
    assert loads.refresh_flights(spark, str(bronze), silver) == [(1998, 1), (1998, 2)]
    expected = flight_facts(raw).drop("FactID")  # the month of the file, not the record's 9
    assert values(scan.parquet(spark, silver).select(*expected.columns)) == values(expected)


@pytest.mark.parametrize(
    ("name", "pattern", "expected"),
    [
        ("storm_events_2024_03.parquet", scan.STORM_FILES, "2024_03"),
        ("storm_events_2024_03_v2.parquet", scan.STORM_FILES, "2024_03"),
        ("2024_3_aotd.parquet", scan.FLIGHT_FILES, "2024_3"),
        ("2024_3_other.parquet", scan.FLIGHT_FILES, ""),
        ("plane_registry_2024-05-01.parquet", scan.AIRCRAFT_FILES, "2024-05-01"),
    ],
)
def test_file_name_patterns(name, pattern, expected):
    found = re.search(pattern, listing.Entry(f"file:/run_2020_11/x/{name}", False).name)
    assert ("_".join(found.groups()) if found else "") == expected


def test_overwrite_touches_only_its_months(spark, rows, tmp_path):
    path, schema = str(tmp_path / "t"), "year_partition int, month_partition int, x int"
    sink.overwrite_periods(rows(schema, (2024, 1, 1), (2024, 2, 2)), path)
    sink.overwrite_periods(rows(schema, (2024, 2, 9)), path, rebalance=True, sort=["x"])
    sink.overwrite_periods(rows(schema, (2024, 2, 9)).limit(0), path)
    assert values(scan.parquet(spark, path).select("month_partition", "x")) == [(1, 1), (2, 9)]
    assert values(scan.stored_periods(spark, path)) == [(2024, 1), (2024, 2)]
    pruned = scan.parquet(spark, path).filter("year_partition = 2024 AND month_partition = 2")
    assert files_read(pruned) == 1


def test_audit_reports_lost_rows(spark, rows, tmp_path):
    df = rows("YEAR int, BEGIN_YEARMONTH int", (2024, 202401), (2024, 202401), (2024, 202412))
    path = str(tmp_path / "t")
    report = sink.split_by_month(df, path, "YEAR", "BEGIN_YEARMONTH")
    assert values(report) == [(2024, 1, 2, 3, 3, 0, True), (2024, 12, 1, 3, 3, 0, True)]
    again = sink.split_by_month(df.filter("BEGIN_YEARMONTH = 202412"), path, "YEAR", "BEGIN_YEARMONTH")
    assert values(again) == [(2024, 12, 1, 1, 1, 0, True)]  # the other month is no false alarm
    rows_in = scan.parquet(spark, path)
    lost = sink.audit(rows_in.filter("month_partition = 1"), rows_in)
    assert values(lost) == [(2024, 1, 2, 3, 2, 0, False), (2024, 12, 0, 3, 2, 0, False)]


def test_keyed_rows_are_found_by_key_and_prefix(spark, tmp_path):
    path = str(tmp_path / "kv")
    df = spark.range(3000).select(F.format_string("%04d#x", "id").alias("rowkey"), F.create_map(F.lit("v"), F.col("id").cast("string")).alias("cells"))
    sink.write_keyed(df, path)
    found = scan.parquet(spark, path).filter(F.col("rowkey").startswith("0017#"))
    assert values(found) == [("0017#x", {"v": "17"})]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(rowkey,0017#)" in plan


def test_external_tables(spark, rows, tmp_path):
    path = str(tmp_path / "weather")
    catalog.create_database(spark, "silver_ddl")
    for table, (_, monthly) in catalog.SILVER_TABLES.items():
        name = catalog.create_silver(spark, table, f"{path}/{table}", "silver_ddl")
        assert catalog.table_exists(spark, name)
        assert ("month_partition" in spark.table(name).columns) == monthly
    name = "silver_ddl.flight_facts"
    empty = spark.table(name)
    one = rows("year_partition int, month_partition int, TailNumber string", (2024, 5, "N1"))
    full = one.select(*[c if c in one.columns else F.lit(None).cast(t).alias(c) for c, t in empty.dtypes])
    sink.overwrite_periods(full, f"{path}/flight_facts")
    assert spark.table(name).count() == 0
    catalog.refresh(spark, name, monthly=True)
    assert values(catalog.table_periods(spark, name)) == [(2024, 5)]
    assert values(spark.table(name).select("TailNumber", "month_partition")) == [("N1", 5)]
    assert catalog.optional_table(spark, "silver_ddl.nothing") is None


def test_registry_load_keeps_the_newest_copy(spark, tmp_path):
    def csv(name, *lines):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "MASTER.txt").write_text("N-NUMBER,MFR,MODEL,TYPE AIRCRAFT,TYPE ENGINE,YEAR MFR\n" + "\n".join(lines) + "\n")
        return str(folder)

    bronze, silver = str(tmp_path / "bronze"), str(tmp_path / "silver")
    loads.load_registry_bronze(spark, csv("a", '100A ,"ACME, INC",X1,4,1,1998', "200B,B,Y,9,99,    "), bronze, "2024-05-01")
    loads.load_registry_bronze(spark, csv("b", "100A ,ACME2,X1,5,1,1999"), bronze, "2024-06-01")
    stored = scan.parquet(spark, bronze)
    assert {"N-NUMBER", "TYPE_AIRCRAFT", "aircraft_type", "engine_type", "snapshot_date"} <= set(stored.columns)
    loads.refresh_aircraft(spark, bronze, silver)
    expected = [
        ("N100A", "ACME2", "X1", "Fixed wing multi engine", "Reciprocating", 1999),
        ("N200B", "B", "Y", "Gyroplane", None, None),
    ]
    assert values(scan.parquet(spark, silver)) == expected
    loads.load_registry_bronze(spark, csv("c", "100A,CHANGED,X1,5,1,1999", "300C,C,Z,1,1,2000"), bronze, "2024-07-01")
    loads.refresh_aircraft(spark, bronze, silver)
    assert [r[:2] for r in values(scan.parquet(spark, silver))] == [("N100A", "ACME2"), ("N200B", "B"), ("N300C", "C")]
    loads.refresh_aircraft(spark, bronze, silver, full=True)
    assert values(scan.parquet(spark, silver))[0][1] == "CHANGED"


def test_dated_files_by_name(spark, rows, tmp_path):
    schema = "`N-NUMBER` string, MFR string, MODEL string, `TYPE_AIRCRAFT` string, `TYPE_ENGINE` string, `YEAR_MFR` string"
    path = str(tmp_path / "planes")
    for date, maker in [("2024-05-01", "OLD"), ("2024-06-01", "AAA")]:
        rows(schema, ("1", maker, "m", "1", "1", "2000")).write.parquet(f"{path}/plane_registry_{date}.parquet")
    rows(schema, ("2", "x", "m", "1", "1", "2000")).write.parquet(f"{path}/other.parquet")
    out = aircraft_dim(scan.registry_snapshots(spark, path), prefer=["snapshot_date"])
    assert values(out.select("TailNum", "ManufacturerName")) == [("N1", "AAA")]


def test_whole_pipeline(spark, tmp_path):
    """Raw files to keyed rows; a second run finds nothing new."""
    raw = {n: fixtures.load(spark, SF, n) for n in fixtures.SQL}
    at = lambda name: str(tmp_path / name)
    named = raw["fx_flights"].withColumn("file", F.concat_ws("_", "YEAR", "MONTH", F.lit("aotd.parquet")))
    named.write.partitionBy("file").parquet(at("raw-flights"))
    raw["fx_airports"].write.parquet(at("raw-airports") + "/L_AIRPORT_ID.parquet")
    aircraft = raw["fx_aircraft"].toDF("N-NUMBER", "MFR", "MODEL", "TYPE AIRCRAFT", "TYPE ENGINE", "YEAR MFR")
    aircraft.write.option("header", True).csv(at("registry-csv"))
    storms = raw["fx_weather"].withColumn("YEAR", F.expr("CAST(BEGIN_YEARMONTH div 100 AS INT)"))
    storm_schema = scan.storm_csv(spark, at("registry-csv")).schema
    fields = [F.col(f.name) if f.name in storms.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in storm_schema]
    storms.select(*fields).write.option("header", True).csv(at("storm-csv"))

    report = loads.load_storm_bronze(spark, at("storm-csv"), at("storms"))
    assert report.filter("NOT verified").isEmpty() and not report.isEmpty()
    loads.load_registry_bronze(spark, at("registry-csv"), at("registry"), "2024-05-01")

    months = loads.refresh_flights(spark, at("raw-flights"), at("flights"))
    loads.refresh_airports(spark, at("raw-airports"), at("airports"))
    loads.refresh_aircraft(spark, at("registry"), at("aircraft"))
    airports = scan.airport_reference(spark, at("raw-airports"))
    stormy = loads.refresh_weather(spark, at("storms"), airports, at("weather"), radius_km=300)
    assert len(months) == raw["fx_flights"].select("YEAR", "MONTH").distinct().count()
    assert len(stormy) == storms.select("YEAR", "BEGIN_YEARMONTH").distinct().count()
    assert loads.refresh_flights(spark, at("raw-flights"), at("flights")) == []
    assert loads.refresh_flights(spark, at("raw-flights"), at("flights"), only=[(2050, 1), months[0]]) == [months[0]]
    before = values(scan.parquet(spark, at("airports")))
    loads.refresh_airports(spark, at("raw-airports"), at("airports"))
    assert values(scan.parquet(spark, at("airports"))) == before

    catalog.create_database(spark, "silver_e2e")
    folders = {"flight_facts": "flights", "airport_dim": "airports", "aircraft_dim": "aircraft", "weather_airport_events": "weather"}
    for table, folder in folders.items():
        name = catalog.create_silver(spark, table, at(folder), "silver_e2e")
        catalog.refresh(spark, name, monthly=catalog.SILVER_TABLES[table][1])
    assert spark.table("silver_e2e.flight_facts").count() == raw["fx_flights"].count()
    built = loads.serve(spark, at("kv"), silver="silver_e2e", serving="serving_e2e")
    assert set(built) == set(VIEWS)
    for name in built:
        keyed = scan.parquet(spark, at("kv") + f"/{name}")
        assert keyed.count() == spark.table(f"serving_e2e.{name}").count() > 0
    with pytest.raises(ValueError, match="missing table"):
        loads.serve(spark, at("kv2"), silver="nowhere")


def test_months_with_different_types(spark, tmp_path):
    raw = fixtures.load(spark, SF, "fx_flights").filter("YEAR = 1998 AND MONTH IN (1, 2)").drop("FLIGHT_KEY")
    bronze, silver = str(tmp_path / "raw"), str(tmp_path / "silver")
    raw.filter("MONTH = 1").write.parquet(f"{bronze}/1998_1_aotd.parquet")
    text = raw.filter("MONTH = 2").select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    text.write.parquet(f"{bronze}/1998_02_aotd.parquet")
    assert loads.refresh_flights(spark, bronze, silver) == [(1998, 1), (1998, 2)]
    expected = flight_facts(raw).drop("FactID")
    assert values(scan.parquet(spark, silver).select(*expected.columns)) == values(expected)


def test_weather_from_named_files(spark, tmp_path):
    raw = fixtures.load(spark, SF, "fx_weather").filter("BEGIN_YEARMONTH IN (199805, 199910)")
    for month in (199805, 199910):
        name = f"storm_events_{month // 100}_{month % 100:02d}.parquet"
        raw.filter(F.col("BEGIN_YEARMONTH") == month).write.parquet(str(tmp_path / "raw" / name))
    airports, out = fixtures.load(spark, SF, "fx_airports"), str(tmp_path / "out")
    bronze = str(tmp_path / "raw")
    assert loads.refresh_weather(spark, bronze, airports, out, only=[(1998, 5)], radius_km=500) == [(1998, 5)]
    assert values(scan.stored_periods(spark, out)) == [(1998, 5)]
    assert loads.refresh_weather(spark, bronze, airports, out, radius_km=500) == [(1999, 10)]
    assert loads.refresh_weather(spark, bronze, airports, out, full=True, radius_km=500) == [(1998, 5), (1999, 10)]
    late = scan.parquet(spark, out).filter("DATETIME >= '1998-06-01' AND DATETIME < '1999-01-01'")
    assert late.filter("month_partition <> 5").isEmpty()


MONTHLY = "year_partition int, month_partition int, v int"


def stored_rows(spark, path):
    return values(spark.read.schema(MONTHLY).parquet(path).select("year_partition", "month_partition", "v"))


def test_a_run_that_dies_before_the_switch_leaves_the_old_months(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "monthly")
    old = rows(MONTHLY, (2024, 1, 1), (2024, 2, 2))
    sink.replace_periods(old, path, [(2024, 1), (2024, 2)])
    new = rows(MONTHLY, (2024, 1, 10), (2024, 3, 30))
    monkeypatch.setattr(sink.listing, "write_text", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sink.replace_periods(new, path, [(2024, 1), (2024, 2), (2024, 3)])
    assert stored_rows(spark, path) == values(old.select(*MONTHLY.replace(" int", "").split(", ")))
    monkeypatch.undo()
    assert sink.replace_periods(new, path, [(2024, 1), (2024, 2), (2024, 3)]) == [(2024, 2)]
    assert stored_rows(spark, path) == [(2024, 1, 10), (2024, 3, 30)]
    assert not [n for n in listing.names_in(spark, path) if n in (sink.STAGED, sink.REPLACED, sink.SWITCH)]


@pytest.mark.parametrize("renames", range(6))
def test_a_switch_that_dies_anywhere_is_finished_later(spark, rows, tmp_path, monkeypatch, renames):
    path, real = str(tmp_path / "monthly"), listing.rename
    sink.replace_periods(rows(MONTHLY, (2024, 1, 1), (2024, 2, 2), (2024, 4, 4)), path, [(2024, 1), (2024, 2), (2024, 4)])
    done = []

    def rename(*args):
        if len(done) == renames:
            raise OSError("lost")
        done.append(args)
        real(*args)

    monkeypatch.setattr(listing, "rename", rename)
    new = rows(MONTHLY, (2024, 1, 10), (2024, 2, 20), (2024, 3, 30))
    try:
        sink.replace_periods(new, path, [(2024, 1), (2024, 2), (2024, 4)])
    except OSError:
        before = stored_rows(spark, path)
        assert renames > 0 or before == [(2024, 1, 1), (2024, 2, 2), (2024, 4, 4)]
    monkeypatch.undo()
    sink.finish_switch(spark, path)
    if renames:
        assert stored_rows(spark, path) == [(2024, 1, 10), (2024, 2, 20), (2024, 3, 30)]
    assert scan.processed_periods(spark, path).count() == (4 if renames else 3)


def test_rows_without_a_month_are_an_error(rows, tmp_path):
    with pytest.raises(ValueError):
        sink.replace_periods(rows(MONTHLY, (2024, None, 1)), str(tmp_path / "monthly"), [(2024, 1)])


def test_bad_months_cost_few_runs():
    runs = []

    def run(part):
        runs.append(part)
        if 13 in part or 40 in part:
            raise OSError("bad")

    with pytest.raises(loads.MonthsFailed) as error:
        loads._all_or_halves([(m // 12, m) for m in range(64)], lambda part: run([m for _, m in part]))
    assert sorted(m for _, m in error.value.failed) == [13, 40] and len(error.value.done) == 62
    assert len(runs) < 32


def mixed_folder(rows, path):
    """Part files of other columns and types side by side."""
    rows("id int, a string", (1, "x")).coalesce(1).write.parquet(path)
    rows("id string, b double", ("two", 2.5)).coalesce(1).write.mode("append").parquet(path)
    rows("id int, a string, c int", (3, "y", 7)).coalesce(1).write.mode("append").parquet(path)


def test_every_part_file_keeps_its_own_columns(spark, rows, tmp_path):
    path = str(tmp_path / "files")
    mixed_folder(rows, f"{path}/airport_1.parquet")
    rows("id int, a string", (4, "z")).write.parquet(f"{path}/airport_2.parquet")
    out = scan.read_named(spark, path, scan.AIRPORT_FILES)
    assert dict(out.dtypes) == {"id": "string", "a": "string", "b": "double", "c": "int"}
    assert values(out.select("id", "a", "b", "c")) == [("1", "x", None, None), ("3", "y", None, 7), ("4", "z", None, None), ("two", None, 2.5, None)]


def test_months_of_mixed_part_files_in_both_layouts(spark, rows, tmp_path):
    path = str(tmp_path / "2020_11_runs")
    mixed_folder(rows, f"{path}/storm_events_2024_03.parquet")
    mixed_folder(rows, f"{path}/year_partition=2024/month_partition=4")
    rows("id int, a string", (5, "w")).write.parquet(f"{path}/year_partition=2024/month_partition=5")
    months = scan.partition_months(spark, path) + scan.named_months(spark, path, scan.STORM_FILES)
    with scan.month_frames(spark, path, [m for m in months if m[0] == 2024], scan.STORM_FILES) as frames:
        found = [r for df in frames for r in df.select(F.col("id").cast("string"), "c", "year_partition", "month_partition").collect()]
    each = [("1", None), ("3", 7), ("two", None)]
    assert sorted(map(tuple, found), key=repr) == sorted([(*x, 2024, m) for x in each for m in (3, 4)] + [("5", None, 2024, 5)], key=repr)


def test_jobs_do_not_grow_with_the_number_of_files(spark, rows, tmp_path):
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    jobs = []
    for count in (3, 12):
        for k in range(count):
            kind = "id int" if k % 2 else "id string"
            rows(kind, 1 if k % 2 else "1").coalesce(1).write.parquet(str(tmp_path / str(count) / f"{k}.parquet"))
        paths = [e.path for e in listing.entries(spark, str(tmp_path / str(count)))]
        context.setJobGroup(f"footers-{count}", "footers")
        assert sorted(len(group) for _, group in scan.by_schema(spark, paths)) == [count // 2, count - count // 2]
        jobs.append(len(tracker.getJobIdsForGroup(f"footers-{count}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] <= 2


REPORT = schemas.STORM_CSV.replace("\n", " ").split(",")


def report_line(**given):
    return ",".join(str(given.get(c.split()[0], "1" if "STRING" not in c.upper() else "x")) for c in REPORT)


def storm_file(path, *lines, end="\r\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(end.join([",".join(c.split()[0] for c in REPORT), *lines, ""]).encode())


def test_reports_with_quotes_line_breaks_and_rejects(spark, tmp_path):
    text = '"He said ""run, now"", twice.\n\nThen, quiet."'
    storm_file(
        tmp_path / "in" / "1998.csv",
        report_line(YEAR=1998, BEGIN_YEARMONTH=199803, EVENT_ID=1, EVENT_NARRATIVE=text),
        report_line(YEAR=1998, BEGIN_YEARMONTH=199803, EVENT_ID=2, EVENT_NARRATIVE='""'),
        "1998,only two",
        report_line(YEAR="many", BEGIN_YEARMONTH=199803, EVENT_ID=3),
        report_line(YEAR="", BEGIN_YEARMONTH=199803, EVENT_ID=4),
        report_line(YEAR=1998, BEGIN_YEARMONTH=199804, EVENT_ID=5) + ",too,many",
    )
    storm_file(tmp_path / "in" / "1999.csv", report_line(YEAR=1999, BEGIN_YEARMONTH=199912, EVENT_ID=6))
    bronze = str(tmp_path / "bronze")
    audit = loads.load_storm_bronze(spark, str(tmp_path / "in"), bronze)
    assert values(audit) == [(1998, 3, 2, 7, 3, 4, True), (1999, 12, 1, 7, 3, 4, True)]
    stored = scan.parquet(spark, bronze)
    assert values(stored.select("EVENT_ID", "EVENT_NARRATIVE").filter("EVENT_ID < 3")) == [(1, 'He said "run, now", twice.\n\nThen, quiet.'), (2, None)]
    rejected = sink.rejected_rows(spark, bronze)
    assert rejected.count() == 4 and rejected.filter("_corrupt_record IS NULL").select("EVENT_ID").first()[0] == 4
    assert rejected.filter("_corrupt_record = '1998,only two'").count() == 1
    again = loads.load_storm_bronze(spark, str(tmp_path / "in" / "1999.csv"), bronze)
    assert values(again) == [(1999, 12, 1, 1, 1, 0, True)] and scan.parquet(spark, bronze).count() == 3


def test_a_load_reads_its_input_once(spark, rows, tmp_path):
    """By the rows that all scans of CSV files have given, in every job of the load."""
    storm_file(tmp_path / "in" / "1998.csv", *[report_line(YEAR=1998, BEGIN_YEARMONTH=199800 + m, EVENT_ID=m) for m in range(1, 11)])
    rows("`N-NUMBER` string, MFR string, MODEL string, `TYPE AIRCRAFT` string, `TYPE ENGINE` string, `YEAR MFR` string", *[(str(k), "m", "x", "4", "1", "1990") for k in range(10)]).coalesce(1).write.option("header", True).csv(str(tmp_path / "planes"))
    scanned = []
    for load in (
        lambda: loads.load_storm_bronze(spark, str(tmp_path / "in"), str(tmp_path / "bronze")),
        lambda: loads.load_registry_bronze(spark, str(tmp_path / "planes"), str(tmp_path / "registry"), "2024-05-01"),
    ):
        store = spark._jsparkSession.sharedState().statusStore()
        before = store.executionsCount()
        report = load()
        total = 0
        for execution in range(before, store.executionsCount()):
            info = store.executionsList(execution, 1).head()
            metrics = store.executionMetrics(info.executionId())
            nodes = store.planGraph(info.executionId()).allNodes()
            for k in range(nodes.size()):
                if nodes.apply(k).name().startswith("Scan csv"):
                    for j in range(nodes.apply(k).metrics().size()):
                        metric = nodes.apply(k).metrics().apply(j)
                        if metric.name() == "number of output rows" and metrics.contains(metric.accumulatorId()):
                            total += int(metrics.apply(metric.accumulatorId()).replace(",", ""))
        scanned.append((total, report.select("verified").distinct().first()[0]))
    assert scanned == [(10, True), (10, True)]


def test_rows_lost_on_the_way_are_reported(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "overwrite_periods", lambda df, path, **how: df.filter("month_partition = 1").write.partitionBy(*PERIOD).parquet(path))
    df = rows("YEAR int, BEGIN_YEARMONTH int", (2024, 202401), (2024, 202402))
    assert values(sink.split_by_month(df, str(tmp_path / "t"), "YEAR", "BEGIN_YEARMONTH")) == [(2024, 1, 1, 2, 1, 0, False), (2024, 2, 0, 2, 1, 0, False)]


def test_an_unshuffled_write_keeps_the_files_of_its_months_open(spark, rows, tmp_path, monkeypatch):
    """A task sorted all its rows to write one month after the other."""
    key, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (seen.append(spark.conf.get(key)), write(self, path)))
    before, data = spark.conf.get(key), [(k, 2000 + k % 40 // 12, 1 + k % 40 % 12) for k in range(400)]  # more months than files may be open
    mixed = rows("x int, year_partition int, month_partition int", *data).coalesce(1)
    sink.replace_periods(mixed, str(tmp_path / "open"), [])
    sink.replace_periods(mixed, str(tmp_path / "together"), [], rebalance=True)
    assert seen == ["32", before] and spark.conf.get(key) == before
    assert all(values(spark.read.parquet(str(tmp_path / name))) == values(mixed) for name in ("open", "together"))
