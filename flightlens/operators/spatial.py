"""All pairs of a point and a site within a distance, by an equi-join on a grid.

Points fall in one latitude band and one longitude cell. Each site is listed under
every (band, cell) its circle can touch. A pair within the radius therefore meets in
exactly one grid square; an exact distance test removes the rest. Squares scale with the
radius, so candidates stay within a small factor of the result, however crowded a place is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.functions.geo import (
    band,
    band_height,
    bands_within,
    cell,
    cell_count,
    cell_of_band,
    cell_width,
    cells_of_band,
    cells_within,
    furthest_km,
    haversine_km,
    reach_in_longitude,
    squares_along,
    squares_around,
    wrapped,
)
from flightlens.operators.checks import present
from flightlens.operators.combine import fits

# A broadcast row, a site in one grid square, is well under 1 KB, so this many stay below a
# few hundred MB on each executor. Rows are counted as they are broadcast: for points a site is listed under
# the some ten squares its circle touches, for tracks it is one row.
MAX_BROADCAST_SITES = 300_000
SALTS = 16


def within_radius(
    points: DataFrame,
    sites: DataFrame,
    radius_km: float,
    *,
    point: tuple[str, str],
    site: tuple[str, str],
    distance: str = "DISTANCE_KM",
    max_broadcast_sites: int = MAX_BROADCAST_SITES,
    salts: int = SALTS,
) -> DataFrame:
    """Pairs no further apart than ``radius_km``; ``point`` and ``site`` name (lat, lon).

    Few sites (counted once per square they touch) are broadcast: points are never shuffled and a crowded
    square costs nothing extra. Otherwise both sides shuffle on the square and a salt,
    which spreads each square's points over ``salts`` tasks. The
    salt is a hash of the point, the same when a lost task runs again; exact copies of
    a point share it, and the adaptive skew join splits what is still uneven.

    Bands have fewer cells towards the poles, so a circle touches some ten squares there as well.
    """
    (plat, plon), (slat, slon) = point, site
    height, per_circle = band_height(radius_km), 2 * cell_count(radius_km)
    left = points.withColumn("_band", band(F.col(plat), radius_km))
    left = left.withColumn("_cell", cell_of_band(F.col(plon), F.col("_band"), height, per_circle))
    half = reach_in_longitude(F.col(slat), radius_km)
    right = sites.withColumn("_half", F.when(half >= 180, 360.0).otherwise(half))
    right = right.withColumn("_square", F.explode(squares_around(F.col(slat), F.col(slon), radius_km, height, per_circle)))
    right = right.withColumns({"_band": F.col("_square.band"), "_cell": F.col("_square.cell")}).drop("_square")
    left, right, keys = meeting(left, right, max_broadcast_sites, salts)
    km = haversine_km(F.col(slat), F.col(slon), F.col(plat), F.col(plon))
    apart = F.col(slon) - F.col(plon)
    # Cheap, before the trigonometry.
    near = (F.abs(F.col(slat) - F.col(plat)) <= height) & (F.abs(apart - 360 * F.rint(apart / 360)) <= F.col("_half"))
    pairs = left.join(right, keys).filter(near).withColumn(distance, km)
    return pairs.filter(F.col(distance) <= radius_km).drop(*keys, "_half")


def meeting(left: DataFrame, right: DataFrame, max_broadcast_sites: int, salts: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides, ready to be joined, and the columns to join them on: both have ``_band`` and ``_cell``, ``right`` the sites once for every square they are listed under."""
    keys = ["_band", "_cell"]
    if fits(right.select("_band"), max_broadcast_sites):
        right = F.broadcast(right)
    else:
        if salts > 1:
            keys.append("_salt")
            spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts))
            left = left.withColumn("_salt", spread.cast("int"))
            right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        # Sizes guessed from the sites alone, before their squares and salts, would have Spark broadcast them all the same.
        right = right.hint("shuffle_hash")
    return left, right, keys


def tracks_near_sites(
    tracks: DataFrame,
    sites: DataFrame,
    radius_km: float,
    *,
    start: tuple[str, str],
    stop: tuple[str, str],
    steps: str,
    step: str,
    point: tuple[str, str],
    site: tuple[str, str],
    max_broadcast_sites: int = MAX_BROADCAST_SITES,
    salts: int = SALTS,
) -> tuple[DataFrame, Column]:
    """Tracks and sites that may come within ``radius_km``, with the steps at which they may (``_first`` to ``_last``), and a test of such a step.

    A track is one row: a straight line in degrees from ``start`` to ``stop`` (lat, lon) in ``steps`` equal steps (their sign does not matter).
    Few sites are broadcast, one row each, and a track is listed under the squares that may hold a site within reach of it. Otherwise both shuffle: a
    track is listed under the squares it passes, a site under those its circle can touch. Where they meet, the steps in question are those inside
    the site's box and in this part of the track, one interval each since the track is straight; both are solved for, not tried.
    The intervals are a hair too wide: the test, for the number ``step`` at ``point``, is true in one meeting of a step and a site only. The distance is left to the caller.
    """
    (lat0, lon0), (lat1, lon1) = ((F.col(lat), F.col(lon)) for lat, lon in (start, stop))
    (lat, lon), (slat, slon) = ((F.col(c) for c in place) for place in (point, site))
    # What a track, a square or a site has by itself is computed before they meet. Written out per pair the code of the join would be too large for the JVM to compile.
    count = F.abs(F.col(steps)).cast("double")
    left = tracks.withColumn("_count", count)
    for k, (begin, end) in enumerate(((lat0, lat1), (lon0, lon1))):
        left = left.withColumn(f"_still{k}", (F.col("_count") == 0) | (F.abs(end - begin) < 1e-9))
        left = left.withColumn(f"_per_degree{k}", F.when(F.col(f"_still{k}"), 0.0).otherwise(F.try_divide(F.col("_count"), end - begin)))
    half = reach_in_longitude(slat, radius_km)
    height = band_height(radius_km)
    boxed = sites.withColumns({"_south": slat - height, "_north": slat + height, "_half": F.when(half >= 180, 360.0).otherwise(half)})
    meet = tracks_meeting_few if fits(sites, max_broadcast_sites) else tracks_meeting_many
    met, (lat_range, lon_range, *part), here = meet(left, boxed, radius_km, ((lat0, lat1), (lon0, lon1)), (lat, lon), (slat, slon), step, max_broadcast_sites, salts)

    firsts, lasts = [F.lit(0.0), *(low for low, _ in part)], [F.col("_count"), *(high for _, high in part)]
    for k, (begin, (low, high)) in enumerate(((lat0, lat_range), (lon0, lon_range))):
        still = F.col(f"_still{k}")
        inside = (begin >= low - 1e-8) & (begin <= high + 1e-8)
        ends = [(x - begin) * F.col(f"_per_degree{k}") for x in (low, high)]
        firsts.append(F.when(still, F.when(inside, 0.0).otherwise(F.col("_count") + 1)).otherwise(F.least(*ends)))
        lasts.append(F.when(still, F.col("_count")).otherwise(F.greatest(*ends)))
    first, last = F.greatest(*firsts), F.least(*lasts)
    slack = 1e-6 + 1e-9 * F.col("_count")
    met = met.withColumns({"_first": F.ceil(first - slack).cast("long"), "_last": F.floor(last + slack).cast("long")})
    met = met.withColumns({"_first": F.greatest("_first", F.lit(0).cast("long")), "_last": F.least("_last", F.col("_count").cast("long"))})
    return met.filter("_first <= _last"), here


def tracks_meeting_few(left: DataFrame, boxed: DataFrame, radius_km: float, track, point, site, step: str, *_) -> tuple[DataFrame, list, Column]:
    """Sites in their own square, broadcast; tracks in parts no longer than a square, each a row for every square that may hold a site in reach of it.
    A step belongs to the meeting of its own part in which the site is seen on its side of the antimeridian."""
    c = F.col
    (_, lon), (slat, slon) = point, site
    height, per_circle = band_height(radius_km), 2 * cell_count(radius_km)
    moves = [F.when(c("_count") == 0, 0.0).otherwise(end - begin) for begin, end in track]
    parts = F.greatest(F.lit(1), F.ceil(F.abs(moves[0]) / height), F.ceil(F.abs(moves[1]) * per_circle / 360))
    left = left.withColumns({"_move0": moves[0], "_move1": moves[1], "_parts": parts})
    left = left.withColumn("_per_part", F.greatest(c("_count"), F.lit(1.0)) / c("_parts"))
    left = left.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), c("_parts").cast("long") - 1)))
    for k, (begin, _) in enumerate(track):
        ends = [begin + (c("_part") + e) / c("_parts") * c(f"_move{k}") for e in (0, 1)]
        left = left.withColumns({f"_low{k}": F.least(*ends) - 1e-9, f"_high{k}": F.greatest(*ends) + 1e-9})
    left = left.withColumn("_reach", reach_in_longitude(F.greatest(F.abs("_low0"), F.abs("_high0")), radius_km))
    bands = [F.floor(side / height).cast("int") for side in (c("_low0") - height, c("_high0") + height)]
    left = left.withColumn("_band", F.explode(F.sequence(*bands))).withColumn("_cells", cells_of_band(c("_band"), height, per_circle))
    cells = [F.floor(side * c("_cells") / 360).cast("int") for side in (c("_low1") - c("_reach"), c("_high1") + c("_reach"))]
    left = left.withColumn("_raw", F.explode(F.sequence(*cells)))
    left = left.withColumns({"_cell": F.pmod("_raw", "_cells"), "_middle": (c("_raw") + 0.5) * 360 / c("_cells")})
    left = left.drop("_move0", "_move1", "_low0", "_high0", "_low1", "_high1", "_reach", "_raw", "_cells")
    right = boxed.withColumn("_band", band(slat, radius_km))
    right = right.withColumn("_cell", cell_of_band(slon, c("_band"), height, per_circle))
    met = left.join(F.broadcast(right), ["_band", "_cell"]).withColumn("_turn", F.floor((c("_middle") - slon + 180) / 360))
    turned = slon + 360 * c("_turn")
    ranges = [(c("_south"), c("_north")), (turned - c("_half"), turned + c("_half")), (c("_part") * c("_per_part"), (c("_part") + 1) * c("_per_part"))]
    own_part = F.least(F.floor(c(step) / c("_per_part")), c("_parts") - 1) == c("_part")
    return met, ranges, own_part & (F.floor((lon - slon + 180) / 360) == c("_turn"))


def tracks_meeting_many(left: DataFrame, boxed: DataFrame, radius_km: float, track, point, site, step: str, max_broadcast_sites: int, salts: int) -> tuple[DataFrame, list, Column]:
    """Tracks, each a row for every square it passes, shuffled with the sites. A step belongs to the meeting in its own square."""
    (lat, lon), (slat, slon) = point, site
    height, width = band_height(radius_km), cell_width(radius_km)
    left = left.withColumn("_square", F.explode(squares_along(*track, radius_km)))
    left = left.withColumns({"_band": F.col("_square.band"), "_raw": F.col("_square.cell")}).drop("_square").withColumn("_cell", wrapped(F.col("_raw"), radius_km))
    edges = {"_low0": F.col("_band") * height, "_high0": (F.col("_band") + 1) * height, "_low1": F.col("_raw") * width, "_high1": (F.col("_raw") + 1) * width}
    left = left.withColumns({**edges, "_middle": (F.col("_raw") + 0.5) * width})
    listed = boxed.withColumn("_band", F.explode(bands_within(slat, radius_km))).withColumn("_cell", F.explode(cells_within(slat, slon, radius_km)))
    left, right, keys = meeting(left, listed, max_broadcast_sites, salts)
    turned = slon + 360 * F.rint((F.col("_middle") - slon) / 360)  # the site as seen from this side of the antimeridian
    lat_range = F.greatest("_low0", "_south"), F.least("_high0", "_north")
    lon_range = F.greatest(F.col("_low1"), turned - F.col("_half")), F.least(F.col("_high1"), turned + F.col("_half"))
    return left.join(right, keys), [lat_range, lon_range], (band(lat, radius_km) == F.col("_band")) & (cell(lon, radius_km) == F.col("_cell"))


def sites_in_reach(points: DataFrame, sites: DataFrame, radius_km: float, *, point: tuple[str, str], site: tuple[str, str], key: str, by: Sequence[str]) -> DataFrame:
    """For each site ``key`` the distinct ``by`` values of the points within ``radius_km``: those of all pairs, without making the pairs.

    Points fall in squares of a quarter of the radius. Where a whole square lies in a site's circle, its values are the site's: one row each,
    however many points there are. What is left are the values of squares on the circle's edge that no square inside has; there points are tested
    until one is in reach. Rows with a null among ``by`` or without ``key`` are left out.
    """
    (plat, plon), (slat, slon) = point, site
    height, per_circle = band_height(radius_km) / 4, 2 * max(1, int(180 / band_height(radius_km)))
    placed = points.filter(~F.isnan(plat) & ~F.isnan(plon))
    places = present(placed, plat, plon, *by).select(*by, F.col(plat).alias("_plat"), F.col(plon).alias("_plon"))
    places = places.withColumn("_band", F.floor(F.col("_plat") / height).cast("int"))
    places = places.withColumn("_cell", cell_of_band(F.col("_plon"), F.col("_band"), height, per_circle))
    values = places.select("_band", "_cell", *by).distinct()

    listed = present(sites, key).select(key, F.col(slat).alias("_slat"), F.col(slon).alias("_slon")).distinct()
    here = F.col("_slat"), F.col("_slon")
    listed = listed.withColumn("_square", F.explode(squares_around(*here, radius_km, height, per_circle)))
    listed = listed.select("*", "_square.*").withColumnsRenamed({"band": "_band", "cell": "_cell"}).drop("_square")
    inside = F.coalesce(furthest_km(*here, F.col("_band"), F.col("_cell"), height, per_circle) <= radius_km - 1e-6, F.lit(False))
    # Sizes guessed from a few narrow rows are far too small once hours and squares are made of them: nothing here may be broadcast by guess.
    values = values.hint("merge")
    certain = listed.filter(inside).join(values, ["_band", "_cell"]).select(key, *by).distinct()
    open_ = listed.filter(~inside).join(values, ["_band", "_cell"]).join(certain.hint("merge"), [key, *by], "left_anti")
    square = ["_band", "_cell", *by]
    # Points are not made distinct before those that need no test are gone; they stream past the squares to be tested and are never sorted whole.
    asked = places.join(open_.select(*square).distinct().hint("shuffle_hash"), square, "left_semi").distinct()
    tested = asked.withColumnsRenamed({c: f"_of_{c}" for c in square}).hint("merge")
    same = [F.col(c) == F.col(f"_of_{c}") for c in square]
    near = haversine_km(*here, F.col("_plat"), F.col("_plon")) <= radius_km
    found = open_.join(tested, reduce(and_, [*same, near]), "left_semi")
    return certain.unionByName(found.select(key, *by).distinct()).distinct()
