"""Storm alignment, storm hours, and the distance join against brute force."""

import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from flightlens import fixtures
from flightlens.operators.spatial import sites_in_reach, within_radius
from flightlens.plans import storms
from flightlens.plans.storms import aligned_storms, storm_hours, storms_near_airports
from flightlens.registry.storms import rounded

from conftest import values
from test_plans import rows_shuffled

RAW = (
    "EVENT_ID int, BEGIN_YEARMONTH int, BEGIN_DAY int, BEGIN_TIME int, END_YEARMONTH int, END_DAY int, END_TIME int,"
    "EVENT_TYPE string, BEGIN_LAT double, BEGIN_LON double, END_LAT double, END_LON double"
)


def storm(rows, *data):
    return aligned_storms(rows(RAW, *data))


def test_only_listed_events_with_coordinates(rows):
    base = (202401, 1, 1015, 202401, 1, 1130)
    out = storm(
        rows,
        (1, *base, "Hail", 1.0, 2.0, 3.0, 4.0),
        (2, *base, "Drought", 1.0, 2.0, 3.0, 4.0),
        (3, *base, "Hail", None, 2.0, 3.0, 4.0),
        (4, *base, "Dense Fog", 1.0, 2.0, 3.0, 4.0),
    )
    assert values(out.select("ORIGINAL_INDEX", "EVENT_CATEGORY_ID")) == [(1, 1), (4, 4)]


def test_hours_up_down_none_and_invalid(rows):
    place = ("Hail", 0.0, 0.0, 1.0, -1.0)
    out = storm_hours(
        storm(
            rows,
            (1, 202401, 1, 1015, 202401, 1, 1115, *place),  # 10:00 to 12:00
            (2, 202401, 1, 1215, 202401, 1, 930, *place),  # 12:00 to 10:00
            (3, 202401, 1, 1015, 202401, 1, 930, *place),  # 10:00 to 10:00
            (4, 202402, 30, 1015, 202402, 30, 1115, *place),  # no such day
            (5, 202401, 31, 2330, 202402, 1, 10, *place),  # over the end of the month
        )
    )
    got = values(
        out.select(
            "ORIGINAL_INDEX", "HOUR_OFFSET", F.date_format("DATETIME", "MM-dd HH"), "INTERPOLATION_FACTOR", "LATITUDE", "LONGITUDE"
        ),
        "ORIGINAL_INDEX",
        F.abs("HOUR_OFFSET"),
    )
    assert got == [
        (1, 0, "01-01 10", 0.0, 0.0, 0.0),
        (1, 1, "01-01 11", 0.5, 0.5, -0.5),
        (1, 2, "01-01 12", 1.0, 1.0, -1.0),
        (2, 0, "01-01 12", 0.0, 0.0, 0.0),
        (2, -1, "01-01 11", 0.5, 0.5, -0.5),
        (2, -2, "01-01 10", 1.0, 1.0, -1.0),
        (3, 0, "01-01 10", 0.0, 0.0, 0.0),
        (5, 0, "01-31 23", 0.0, 0.0, 0.0),
        (5, 1, "02-01 00", 0.5, 0.5, -0.5),
        (5, 2, "02-01 01", 1.0, 1.0, -1.0),
    ]


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(a[1] - b[1]) / 2) ** 2
    return 6371 * 2 * math.asin(min(1, math.sqrt(h)))


def points(n, seed):
    rng = random.Random(seed)
    spots = [(90.0, 0.0), (-90.0, 10.0), (89.9, -179.9), (0.0, 180.0), (0.0, -180.0), (0.0, 0.0), (45.0, 179.99), (45.0, -179.99)]
    near = [(lat + rng.uniform(-0.5, 0.5), lon + rng.uniform(-0.5, 0.5)) for lat, lon in spots[3:] for _ in range(n // 20)]
    polar = [(rng.choice([-1, 1]) * rng.uniform(88.5, 90), rng.uniform(-180, 180)) for _ in range(n // 4)]
    crowd = [(33.6 + rng.uniform(-0.01, 0.01), -84.4) for _ in range(n // 3)]
    anywhere = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n // 4)]
    return spots + near + polar + crowd + anywhere


@pytest.mark.parametrize("radius", [5, 50, 400, 9000])
@pytest.mark.parametrize("options", [{}, {"max_broadcast_sites": 0}, {"max_broadcast_sites": 0, "salts": 1}])
def test_pairs_equal_brute_force(rows, radius, options):
    left, right = points(240, 1), points(120, 2)
    found = within_radius(
        rows("p int, plat double, plon double", *[(i, *x) for i, x in enumerate(left)]),
        rows("s int, slat double, slon double", *[(i, *x) for i, x in enumerate(right)]),
        radius,
        point=("plat", "plon"),
        site=("slat", "slon"),
        distance="km",
        **options,
    )
    assert found.columns == ["p", "plat", "plon", "s", "slat", "slon", "km"]
    got = [(r.p, r.s) for r in found.select("p", "s").collect()]
    distances = {(i, j): km(a, b) for i, a in enumerate(left) for j, b in enumerate(right)}
    clear = {pair for pair, d in distances.items() if d <= radius - 1e-6}
    edge = {pair for pair, d in distances.items() if abs(d - radius) < 1e-6}
    assert len(got) == len(set(got))
    assert clear <= set(got) <= clear | edge
    assert len(clear) > 100


def test_distance_limit_and_missing_coordinates(rows):
    degree = 6371 * math.pi / 180
    sites = rows("s int, slat double, slon double", (1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 0.0))
    pts = rows("p int, plat double, plon double", (1, 49.999 / degree, 0.0), (2, 50.001 / degree, 0.0), (3, None, 1.0), (4, 0.0, float("nan")))
    found = within_radius(pts, sites, 50, point=("plat", "plon"), site=("slat", "slon"))
    assert values(found.select("p", "s")) == [(1, 1)]


AIRPORTS = "AIRPORT_ID string, DISPLAY_AIRPORT_NAME string, AIRPORT_COUNTRY_NAME string, LATITUDE double, LONGITUDE double"


def test_result_columns_order_and_country(rows):
    airports = rows(AIRPORTS, ("2", "B", "Canada", 0.1, 0.0), ("1", "A", "United States", 0.0, 0.0))
    storms = storm(rows, (7, 202401, 1, 1015, 202401, 1, 1020, "Hail", 0.0, 0.0, 0.0, 0.0))
    out = storms_near_airports(storms, airports, ordered=True)
    assert out.columns == [
        "ORIGINAL_WEATHER_INDEX", "DATETIME", "WEATHER_LATITUDE", "WEATHER_LONGITUDE", "EVENT_TYPE", "EVENT_CATEGORY_ID",
        "BEGIN_DATETIME", "END_DATETIME", "HOUR_OFFSET", "INTERPOLATION_FACTOR", "AIRPORT_ID", "DISPLAY_AIRPORT_NAME",
        "AIRPORT_COUNTRY_NAME", "AIRPORT_LATITUDE", "AIRPORT_LONGITUDE", "DISTANCE_KM",
    ]
    got = [(r.HOUR_OFFSET, r.AIRPORT_ID, round(r.DISTANCE_KM, 1)) for r in out.collect()]
    assert got == [(0, 1, 0.0), (0, 2, 11.1), (1, 1, 0.0), (1, 2, 11.1)]
    assert storms_near_airports(storms, airports, country="Canada", spread=0).count() == 2


def test_a_storm_of_centuries_is_listed_and_loses_no_hour(spark, rows):
    schema = "ORIGINAL_INDEX bigint, BEGIN_DATETIME timestamp, END_DATETIME timestamp, BEGIN_LAT double, BEGIN_LON double, END_LAT double, END_LON double, EVENT_TYPE string, EVENT_CATEGORY_ID int"
    df = rows(schema, (1, None, None, 1.0, 2.0, 3.0, 4.0, "Hail", 1)).drop("BEGIN_DATETIME", "END_DATETIME")
    span = df.withColumns({"BEGIN_DATETIME": F.lit("1998-01-01").cast("timestamp"), "END_DATETIME": F.lit("2198-01-01").cast("timestamp")})
    back = span.withColumns({"ORIGINAL_INDEX": F.lit(2).cast("bigint"), "BEGIN_DATETIME": F.col("END_DATETIME"), "END_DATETIME": F.lit("2197-09-01").cast("timestamp")})
    both = span.unionByName(back)
    hours = storms.storm_hours(both).groupBy("ORIGINAL_INDEX").agg(F.count("*"), F.count_distinct("HOUR_OFFSET"), F.min("HOUR_OFFSET"), F.max("HOUR_OFFSET"))
    days = 200 * 365 + 49
    assert values(hours) == [(1, days * 24 + 1, days * 24 + 1, 0, days * 24), (2, 122 * 24 + 1, 122 * 24 + 1, -122 * 24, 0)]
    assert [r.ORIGINAL_INDEX for r in storms.long_storms(both).collect()] == [1]


TRACKS = "ORIGINAL_INDEX bigint, BEGIN_DATETIME timestamp, END_DATETIME timestamp, BEGIN_LAT double, BEGIN_LON double, END_LAT double, END_LON double, EVENT_TYPE string, EVENT_CATEGORY_ID int"
SITES = "AIRPORT_ID int, DISPLAY_AIRPORT_NAME string, AIRPORT_COUNTRY_NAME string, LATITUDE double, LONGITUDE double"


def random_tracks(draw, n):
    """Still, slow, fast, straight north, along a parallel, backwards, zero hours, over the poles' edge and the antimeridian."""
    start = datetime.datetime(2024, 1, 1)
    for k in range(n):
        lat, lon = draw.choice([(draw.uniform(30, 34), draw.uniform(-100, -96)), (draw.uniform(87, 90), draw.uniform(-180, 180)), (draw.uniform(-2, 2), draw.choice([-1, 1]) * draw.uniform(178, 180))])
        step = draw.choice([0.0, 0.1, 1.0, 6.0])
        to = (min(90.0, lat + draw.choice([0, 1]) * draw.uniform(-step, step)), max(-180.0, min(180.0, lon + draw.choice([0, 1]) * draw.uniform(-step, step))))
        hours = draw.choice([0, 1, 2, 24, 200, -5])
        yield (k, start, start + datetime.timedelta(hours=hours), lat, lon, *to, "Hail", 1)


@pytest.mark.parametrize("limit", [0, 100_000])
def test_tracks_meet_the_airports_that_their_hours_meet(rows, limit):
    """Against every hour of every storm with every airport, on both plans."""
    draw = random.Random(11)
    tracks = list(random_tracks(draw, 150))
    near = [t[3:5] for t in tracks[::3]] + [t[5:7] for t in tracks[1::3]]
    sites = [(k, "n", "c", max(-90.0, min(90.0, lat + draw.uniform(-0.5, 0.5))), lon + draw.uniform(-0.5, 0.5)) for k, (lat, lon) in enumerate(near)]
    sites = [(*s[:4], s[4] - 360 if s[4] > 180 else s[4] + 360 if s[4] < -180 else s[4]) for s in sites]
    df, airports = rows(TRACKS, *tracks), rows(SITES, *sites, (999, "x", "c", None, None))
    want = set()
    for h in storm_hours(df).collect():
        for k, _, _, lat, lon in sites:
            a = math.sin(math.radians(lat - h.LATITUDE) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(h.LATITUDE)) * math.sin(math.radians(lon - h.LONGITUDE) / 2) ** 2
            if 6371 * 2 * math.asin(math.sqrt(a)) <= 50:
                want.add((h.ORIGINAL_INDEX, h.HOUR_OFFSET, k))
    got = storms_near_airports(df, airports, max_broadcast_sites=limit).select("ORIGINAL_WEATHER_INDEX", "HOUR_OFFSET", "AIRPORT_ID").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == want and len(want) > 1000


@pytest.mark.parametrize("limit", [0, 60])
def test_long_tracks_meet_each_airport_once_an_hour(rows, limit):
    """Tracks around the globe, over a pole, of more parts than hours, and of no hour; airports listed once each are few enough to be broadcast."""
    draw, start = random.Random(3), datetime.datetime(2024, 1, 1)
    ways = [(89.2, -179, 89.9, 179, 400), (-89.8, 170, -88, -170, 300), (0.3, -180, -0.3, 180, 900), (10, 180, 10, -180, 720), (40, 5, 60, 95, 3), (40, 5, 60, 95, 0), (60, 20, 60, 24, -90), (90, 0, 88, 0, 40), (89.9, 0, 89.9, 0, 2)]
    tracks = [(k, start, start + datetime.timedelta(hours=h), float(lat), float(lon), float(to), float(too), "Hail", 1) for k, (lat, lon, to, too, h) in enumerate(ways)]
    on = [(t[3] + f * (t[5] - t[3]), t[4] + f * (t[6] - t[4])) for t in tracks for f in (0, 0.25, 0.33, 0.7, 0.999, 1)]
    spots = [(max(-90.0, min(90.0, lat + draw.uniform(-0.3, 0.3))), lon + draw.uniform(-0.3, 0.3)) for lat, lon in on] + [(90.0, 0.0), (-90.0, 77.0), (0.0, 180.0), (0.0, -180.0), (float("nan"), 0.0)]
    sites = [(k, "n", "c", lat, lon - 360 * round(lon / 360) if abs(lon) > 180 else lon) for k, (lat, lon) in enumerate(spots)]
    df, airports = rows(TRACKS, *tracks), rows(SITES, *sites)
    want = {(h.ORIGINAL_INDEX, h.HOUR_OFFSET, k) for h in storm_hours(df).collect() for k, _, _, lat, lon in sites if km((lat, lon), (h.LATITUDE, h.LONGITUDE)) <= 50}
    pairs = storms_near_airports(df, airports, max_broadcast_sites=limit).select("ORIGINAL_WEATHER_INDEX", "HOUR_OFFSET", "AIRPORT_ID")
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    assert ("BroadcastHashJoin" in pairs._jdf.queryExecution().executedPlan().toString()) == bool(limit)


@pytest.mark.parametrize("limit", [0, 100_000])
def test_ordered_pairs_are_sorted_where_they_are_made(rows, limit, monkeypatch):
    """Every pair was shuffled to be sorted. Now a storm is, once, in ranges of storms; nulls and repeated storms too."""
    monkeypatch.setattr(storms, "SORTED_STORMS", 20)
    draw = random.Random(17)
    tracks = [(None if t[0] % 41 == 7 else t[0] % 60, *t[1:3], draw.uniform(30, 31), draw.uniform(-100, -99), draw.uniform(30, 31), draw.uniform(-100, -99), "Hail", 1) for t in random_tracks(draw, 100)]
    airports = rows(SITES, *[(k, "n", "c", draw.uniform(30, 31), draw.uniform(-100, -99)) for k in range(40)])
    df = rows(TRACKS, *tracks)
    pairs = storms_near_airports(df, airports, ordered=True, max_broadcast_sites=limit, spread=3)
    got = [(r[0], r.HOUR_OFFSET, r.DISTANCE_KM, r.AIRPORT_ID) for r in pairs.collect()]
    order = [(i is not None, i, h, km) for i, h, km, _ in got]
    assert all(a <= b for a, b in zip(order, order[1:], strict=False) if a[0] and b[0]) and order == sorted(order, key=lambda x: (x[0], x[1] or 0, *x[2:]))
    plain = storms_near_airports(df, airports).select("ORIGINAL_WEATHER_INDEX", "HOUR_OFFSET", "DISTANCE_KM", "AIRPORT_ID")
    assert sorted(got, key=repr) == values(plain) and len(got) > 10 * len(tracks)
    if limit:
        assert rows_shuffled(pairs) == len(tracks)


def test_few_hours_are_made_that_meet_no_airport(spark):
    """Not all hours of all storms: at most three times the pairs."""
    raw, airports = (fixtures.load(spark, "/root/testdata/sf0.01", f"fx_{name}") for name in ("weather", "airports"))
    aligned = aligned_storms(raw)
    sites = airports.select(F.col("AIRPORT_ID").cast("int"), F.col("LATITUDE").alias("AIRPORT_LATITUDE"), F.col("LONGITUDE").alias("AIRPORT_LONGITUDE"))
    pairs = storms_near_airports(aligned, airports).count()
    assert pairs > 10_000 and storms.hours_in_reach(aligned, sites, 50).count() <= 3 * pairs


def test_building_the_plan_runs_nothing(spark, rows):
    """A shuffle below the storms was run once to learn its number of partitions."""
    df = rows(TRACKS, *random_tracks(random.Random(1), 20)).repartition(7, "ORIGINAL_INDEX").groupBy("ORIGINAL_INDEX").agg(*[F.max(c).alias(c) for c in TRACKS.replace(",", "").split()[2::2]])
    airports = rows(SITES, (1, "n", "c", 31.0, -98.0))
    context = spark.sparkContext
    context.setJobGroup("planning", "planning")
    storm_hours(df)
    storms.dealt_out(df)
    assert not context.statusTracker().getJobIdsForGroup("planning")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert storms_near_airports(df, airports).count() >= 0


@pytest.mark.parametrize("radius", [5, 50, 400, 9000])
def test_values_in_reach_equal_those_of_all_pairs(rows, radius):
    """Near the poles, over the antimeridian, in a crowd; with nulls, NaN and repeated keys."""
    left, right = points(240, 3), points(120, 4)
    kinds = [(i % 40, None if i % 97 == 5 else "abc"[i % 3], *x) for i, x in enumerate(left)] + [(1, "a", None, 0.0), (1, "nan", float("nan"), 0.0), (1, "nan", 0.0, float("nan"))]
    spots = [(None if j == 7 else j // 2, *x) for j, x in enumerate(right)] + [(500, None, 0.0), (501, float("nan"), 0.0)]
    pts, sites = rows("n int, kind string, plat double, plon double", *kinds), rows("s int, slat double, slon double", *spots)
    got = sites_in_reach(pts, sites, radius, point=("plat", "plon"), site=("slat", "slon"), key="s", by=["kind", "n"])
    pairs = within_radius(pts, sites, radius, point=("plat", "plon"), site=("slat", "slon")).select("s", "kind", "n").dropna().distinct()
    assert got.columns == ["s", "kind", "n"] and values(got) == values(pairs) and pairs.count() > 50


@pytest.mark.parametrize("once", [["EVENT_TYPE"], ["EVENT_TYPE", "ORIGINAL_INDEX"]])
def test_airports_once_per_event_equal_those_of_the_pairs(rows, once):
    draw = random.Random(5)
    tracks = [(*t[:7], draw.choice(["Hail", "Tornado"]), 1) for t in random_tracks(draw, 90)]
    sites = [(k, "n", "c", max(-90.0, min(90.0, t[3] + draw.uniform(-0.5, 0.5))), t[4]) for k, t in enumerate(tracks)]
    df, airports = rows(TRACKS, *tracks), rows(SITES, *sites)
    df = df.withColumn("year_partition", F.lit(2024))
    by = [c for c in once if c in storms.HOUR_COLUMNS and c != "ORIGINAL_INDEX"] + ["year_partition"]
    pairs = storms_near_airports(df, airports).select("AIRPORT_ID", *by).distinct()
    assert values(storms_near_airports(df, airports, once=by)) == values(pairs) and pairs.count() > 90


def test_keys_of_a_crowd_are_found_without_its_pairs(spark):
    """300 airports under 40,000 storms: four keys each, and no join that makes a row for a storm and an airport."""
    raw = spark.range(40_000).select("id", (F.col("id") % 4).cast("int").alias("k"), (33 + (F.col("id") % 97) / 970).alias("plat"), (-84 + (F.col("id") % 89) / 890).alias("plon"))
    sites = spark.range(300).select("id", (33 + (F.col("id") % 83) / 830).alias("slat"), (-84 + (F.col("id") % 79) / 790).alias("slon")).withColumnRenamed("id", "s")
    found = sites_in_reach(raw, sites, 50, point=("plat", "plon"), site=("slat", "slon"), key="s", by=["k"])
    assert found.count() == 1200
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and not [line for line in joins if "Broadcast" in line or ("Inner" in line and "_plat" in line)]


def method_sizes(df) -> list[int]:
    """Bytes of the largest generated method of each stage."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))]


def test_the_pair_join_is_compiled(spark, rows):
    """A method of more than 8,000 bytes stays interpreted by the JVM: every pair cost twice the time."""
    raw = rows(f"{RAW}, year_partition int, month_partition int", (1, 199801, 1, 900, 199801, 1, 1200, "Hail", 31.0, -98.0, 31.2, -98.1, 1998, 1))
    airports = rows(SITES, (1, "n", "c", 31.0, -98.0))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = rounded(storms_near_airports(aligned_storms(raw), airports))
        assert pairs.count() == 6 and 0 < max(method_sizes(pairs)) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_shuffled_sites_are_not_broadcast_by_guess(rows):
    """Sites listed under their squares and salts were broadcast whole, for Spark takes them for as small as the sites."""
    pts, sites = rows("plat double, plon double", *points(50, 3)), rows("slat double, slon double", *points(40, 4))
    pairs = within_radius(pts, sites, 400, point=("plat", "plon"), site=("slat", "slon"), max_broadcast_sites=0, salts=3)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
    assert values(pairs) == values(within_radius(pts, sites, 400, point=("plat", "plon"), site=("slat", "slon")))


def test_a_site_near_the_pole_is_listed_under_few_squares(rows):
    """Cells as wide in degrees as at the equator: a circle over the pole touched 1,197 of them, each a shuffled row per salt."""
    sites = [(k, 89.0 + k / 45, 8.0 * k - 180) for k in range(45)]
    pts = [(k, 88.8 + k / 40, 7.0 * k - 180) for k in range(48)] + [(48, 89.99, 180.0), (49, 90.0, 0.0)]
    left, right = rows("p int, plat double, plon double", *pts), rows("s int, slat double, slon double", *sites)
    pairs = within_radius(left, right, 50, point=("plat", "plon"), site=("slat", "slon"), max_broadcast_sites=0, salts=2).select("p", "s")
    want = {(p[0], s[0]) for p in pts for s in sites if km(p[1:], s[1:]) <= 50}
    got = [(r.p, r.s) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert 0 < rows_shuffled(pairs) <= len(pts) + 2 * 20 * len(sites)


def test_only_points_in_squares_to_be_tested_are_made_distinct(rows):
    """All hours of all storms were made distinct before it was known which of them need a test."""
    pts, sites = rows("kind string, plat double, plon double", *[("a", *p) for p in points(50, 3)]), rows("s int, slat double, slon double", *[(k, *p) for k, p in enumerate(points(40, 4))])
    found = sites_in_reach(pts, sites, 400, point=("plat", "plon"), site=("slat", "slon"), key="s", by=["kind"])
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    whole = [k for k, line in enumerate(lines) if re.search(r"Aggregate \[[^\]]*_plat", line)]
    assert len(whole) == 1 and "Join LeftSemi" in "".join(lines[whole[0] + 1 : whole[0] + 3])
