"""Storm reports → hour-aligned storms → one row per storm hour → nearby airports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.codes import EVENT_CATEGORY
from flightlens.functions.geo import haversine_km
from flightlens.functions.keys import load_id
from flightlens.functions.times import hour_after, hour_before, hours_between, stamp
from flightlens.functions.values import decode
from flightlens.operators.checks import present
from flightlens.operators.combine import fits
from flightlens.operators.spatial import MAX_BROADCAST_SITES, SALTS, sites_in_reach, tracks_near_sites
from flightlens.schemas import PERIOD

RADIUS_KM = 50
BLOCK_HOURS = 1_000
LONG_HOURS = 24 * 366
HOUR_COLUMNS = (
    "ORIGINAL_INDEX DATETIME LATITUDE LONGITUDE EVENT_TYPE EVENT_CATEGORY_ID BEGIN_DATETIME END_DATETIME HOUR_OFFSET INTERPOLATION_FACTOR"
).split()
SPLIT_BYTES = 2**27
SORTED_STORMS = 1_000  # their pairs are sorted in memory: some 200 bytes each
UNKNOWN_BYTES = 2**55  # estimates from here on stand for "unknown"


def aligned_storms(raw: DataFrame) -> DataFrame:
    """Storms of the listed event types that have all four coordinates, widened to full hours.

    Both filters use stored columns only and reach the Parquet scan. The storm is
    identified by ``EVENT_ID`` where there is one. Month columns are carried along.
    """
    c = F.col
    has_id = "EVENT_ID" in raw.columns
    listed = raw.filter(c("EVENT_TYPE").isin(list(EVENT_CATEGORY)))
    kept = present(listed, "BEGIN_LAT", "BEGIN_LON", "END_LAT", "END_LON")
    return kept.select(
        (c("EVENT_ID").cast("bigint") if has_id else load_id()).alias("ORIGINAL_INDEX"),
        hour_before(stamp(c("BEGIN_YEARMONTH"), c("BEGIN_DAY"), c("BEGIN_TIME"))).alias("BEGIN_DATETIME"),
        hour_after(stamp(c("END_YEARMONTH"), c("END_DAY"), c("END_TIME"))).alias("END_DATETIME"),
        "BEGIN_LAT",
        "BEGIN_LON",
        "END_LAT",
        "END_LON",
        "EVENT_TYPE",
        decode(c("EVENT_TYPE"), EVENT_CATEGORY).alias("EVENT_CATEGORY_ID"),
        *[p for p in PERIOD if p in raw.columns],
    )


def dealt_out(storms: DataFrame, spread: int | None = None) -> DataFrame:
    """The same rows over ``spread`` tasks, or more if the input has more splits than that. Only the plan is asked for
    its partitions, or its size where it does not know them; nothing is run."""
    if spread is None:
        spread = int(storms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = storms._jdf.queryExecution()
    splits = plan.sparkPlan().outputPartitioning().numPartitions()
    if spread <= 0 or splits >= spread:
        return storms
    size = int(plan.optimizedPlan().stats().sizeInBytes())
    return storms.repartition(max(spread, size // SPLIT_BYTES if size < UNKNOWN_BYTES else 0))


def in_ranges(storms: DataFrame, *keys: str, spread: int | None = None) -> DataFrame:
    """The same rows in the order of ``keys`` from task to task, ``SORTED_STORMS`` in each, over ``spread`` tasks at least: pairs made and sorted
    there are in order without being shuffled. Storms are counted for it."""
    if spread is None:
        spread = int(storms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return storms.repartitionByRange(max(spread, -(-storms.count() // SORTED_STORMS), 1), *keys)


def long_storms(storms: DataFrame, hours: int = LONG_HOURS) -> DataFrame:
    """Aligned storms of more than ``hours`` hours in either direction, longest first, to be checked by eye."""
    span = storms.withColumn("HOURS", hours_between(F.col("BEGIN_DATETIME"), F.col("END_DATETIME")))
    return span.filter(F.abs("HOURS") > hours).orderBy(F.desc(F.abs("HOURS")), "ORIGINAL_INDEX")


def with_hours(storms: DataFrame) -> DataFrame:
    """What each hour of a storm is made from: its signed hours, the steps of its track (one at least), and how far that goes in degrees."""
    c = F.col
    hours = hours_between(c("BEGIN_DATETIME"), c("END_DATETIME")).cast("long")
    steps = F.greatest(F.abs("_hours"), F.lit(1).cast("long")).cast("double")
    far = {"_far_lat": c("END_LAT") - c("BEGIN_LAT"), "_far_lon": c("END_LON") - c("BEGIN_LON")}
    return storms.withColumn("_hours", hours).withColumns({"_steps": steps, **far})


def each_hour(span: DataFrame, first: Column, last: Column) -> DataFrame:
    """A row for each hour from the ``first`` to the ``last`` of a storm, counted away from its begin, in blocks; with its time and place
    and ``HOUR_OFFSET``, negative for a storm that ends before it begins."""
    c = F.col
    span = span.withColumns({"_from": first, "_to": last})
    span = span.withColumn("_block", F.explode(F.sequence(F.expr(f"_from div {BLOCK_HOURS}"), F.expr(f"_to div {BLOCK_HOURS}"))))
    within = F.sequence(F.greatest("_from", c("_block") * BLOCK_HOURS), F.least("_to", (c("_block") + 1) * BLOCK_HOURS - 1))
    hours = span.withColumn("_step", F.explode(within))
    signed = F.when(c("_hours") < 0, -c("_step")).otherwise(c("_step")).cast("int")
    hours = hours.withColumns({"HOUR_OFFSET": signed, "INTERPOLATION_FACTOR": c("_step").cast("double") / c("_steps")})
    return hours.withColumns(
        {
            "DATETIME": F.timestamp_add("HOUR", c("HOUR_OFFSET"), c("BEGIN_DATETIME")),
            "LATITUDE": c("BEGIN_LAT") + c("INTERPOLATION_FACTOR") * c("_far_lat"),
            "LONGITUDE": c("BEGIN_LON") + c("INTERPOLATION_FACTOR") * c("_far_lon"),
        }
    )


def storm_hours(storms: DataFrame, *, spread: int | None = None) -> DataFrame:
    """One row per hour of each storm, at its place on the straight track.

    A storm that ends before it begins counts its hours downwards; one without a valid
    begin or end gives no row; one of zero hours gives its begin point. Hours are made in
    blocks, so a storm with a mistyped year is long, but never one large array; ``long_storms``
    lists such storms.

    Storm files are small, but each storm becomes tens of hours. So the storms, still one
    narrow row each, are first dealt out evenly over ``spread`` tasks: by default as many as
    ``spark.sql.shuffle.partitions``, more for an input of more splits than that; 0: not at all.
    """
    c = F.col
    span = with_hours(dealt_out(storms, spread))
    return each_hour(span, F.lit(0).cast("long"), F.abs("_hours")).select(
        *HOUR_COLUMNS,
        *[p for p in PERIOD if p in storms.columns],
    )


def hours_in_reach(storms: DataFrame, sites: DataFrame, radius_km: float, *, spread: int | None = None, **how) -> DataFrame:
    """Storms, the sites their tracks come near, and the hours at which they may be in reach: a storm is one row until then."""
    tracks = with_hours(dealt_out(storms, spread)).filter(F.col("_hours").isNotNull())
    near, here = tracks_near_sites(
        tracks,
        sites,
        radius_km,
        start=("BEGIN_LAT", "BEGIN_LON"),
        stop=("END_LAT", "END_LON"),
        steps="_hours",
        step="_step",
        point=("LATITUDE", "LONGITUDE"),
        site=("AIRPORT_LATITUDE", "AIRPORT_LONGITUDE"),
        **how,
    )
    return each_hour(near, F.col("_first"), F.col("_last")).filter(here)


def storms_near_airports(
    storms: DataFrame,
    airports: DataFrame,
    radius_km: float = RADIUS_KM,
    *,
    country: str | None = None,
    ordered: bool = False,
    spread: int | None = None,
    max_broadcast_sites: int = MAX_BROADCAST_SITES,
    salts: int = SALTS,
    once: Sequence[str] = (),
) -> DataFrame:
    """Every (storm hour, airport) within the radius, from aligned storms.

    ``airports`` must hold one row per airport, with coordinates in double precision.
    ``ordered`` sorts the whole result by storm, hour and distance; stored tables are
    sorted within files instead. Few airports are broadcast: then storms are put in order, one row each, and their
    pairs are sorted where they are made. ``spread`` as in ``storm_hours``.

    ``once`` names columns of storms: instead of the pairs, whose number is that of storms times airports, the result has each ``AIRPORT_ID`` once
    with each combination of them that is among its pairs. Nulls are left out.
    """
    c = F.col
    if country is not None:
        airports = airports.filter(c("AIRPORT_COUNTRY_NAME") == country)
    sites = airports.select(
        c("AIRPORT_ID").try_cast("int").alias("AIRPORT_ID"),
        "DISPLAY_AIRPORT_NAME",
        "AIRPORT_COUNTRY_NAME",
        c("LATITUDE").alias("AIRPORT_LATITUDE"),
        c("LONGITUDE").alias("AIRPORT_LONGITUDE"),
    )
    if once:
        place, to = ("LATITUDE", "LONGITUDE"), ("AIRPORT_LATITUDE", "AIRPORT_LONGITUDE")
        return sites_in_reach(storm_hours(storms, spread=spread), sites, radius_km, point=place, site=to, key="AIRPORT_ID", by=once)
    in_order = ordered and fits(sites, max_broadcast_sites)  # storms stay where they are when airports are broadcast
    if in_order:
        storms, spread = in_ranges(storms, "ORIGINAL_INDEX", spread=spread), 0
    hours = hours_in_reach(storms, sites, radius_km, spread=spread, max_broadcast_sites=max_broadcast_sites, salts=salts)
    km = haversine_km(c("AIRPORT_LATITUDE"), c("AIRPORT_LONGITUDE"), c("LATITUDE"), c("LONGITUDE"))
    pairs = hours.withColumn("DISTANCE_KM", km).filter(c("DISTANCE_KM") <= radius_km)
    pairs = pairs.select(*HOUR_COLUMNS, *sites.columns, "DISTANCE_KM", *[p for p in PERIOD if p in storms.columns])
    pairs = pairs.withColumnsRenamed({"ORIGINAL_INDEX": "ORIGINAL_WEATHER_INDEX", "LATITUDE": "WEATHER_LATITUDE", "LONGITUDE": "WEATHER_LONGITUDE"})
    order = ["ORIGINAL_WEATHER_INDEX", "HOUR_OFFSET", "DISTANCE_KM"]
    return pairs.sortWithinPartitions(*order) if in_order else pairs.orderBy(*order) if ordered else pairs
