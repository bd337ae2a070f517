"""Great-circle distance, straight-line tracks and the grid used by the distance join."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km between two points given in degrees."""
    dlat = F.sin(F.radians((lat1 - lat2) / 2))
    dlon = F.sin(F.radians((lon1 - lon2) / 2))
    chord = F.pow(dlat, 2) + F.cos(F.radians(lat2)) * F.cos(F.radians(lat1)) * F.pow(dlon, 2)
    return F.lit(EARTH_RADIUS_KM) * 2 * F.asin(F.sqrt(chord))


def along(start: Column, stop: Column, fraction: Column) -> Column:
    """Coordinate at ``fraction`` of the way from ``start`` to ``stop``."""
    return start + fraction * (stop - start)


def band_height(radius_km: float) -> float:
    """Height of a latitude band in degrees: a little more than the radius, so that two
    points within it lie at most one band apart (one degree is 111.19 km)."""
    return radius_km / 111.0


def band(lat: Column, radius_km: float) -> Column:
    return F.floor(lat / band_height(radius_km)).cast("int")


def cell_count(radius_km: float) -> int:
    """Number of longitude cells around the globe; each is about two radii wide at the equator."""
    return max(1, int(180 / band_height(radius_km)))


def cell_width(radius_km: float) -> float:
    return 360 / cell_count(radius_km)


def cell_at(lon: Column, radius_km: float) -> Column:
    """Cell counted from longitude 0, in either direction."""
    return F.floor(lon / cell_width(radius_km)).cast("int")


def wrapped(cell: Column, radius_km: float) -> Column:
    """Cell counted modulo the number of cells so that the antimeridian joins up."""
    return F.pmod(cell, F.lit(cell_count(radius_km)))


def cell(lon: Column, radius_km: float) -> Column:
    return wrapped(cell_at(lon, radius_km), radius_km)


def cells_of_band(b: Column, height: float, per_circle: int) -> Column:
    """Number of cells of a band in a grid whose cells are about equally wide in km: ``per_circle`` at the equator, fewer towards the poles."""
    nearest = F.least(F.lit(90.0), F.greatest(F.lit(0.0), b * height, -(b + 1) * height))
    return F.greatest(F.lit(1), F.floor(per_circle * F.cos(F.radians(nearest))).cast("int"))


def cell_of_band(lon: Column, b: Column, height: float, per_circle: int) -> Column:
    n = cells_of_band(b, height, per_circle)
    return F.pmod(F.floor(lon * n / 360).cast("int"), n)


def squares_around(lat: Column, lon: Column, radius_km: float, height: float, per_circle: int) -> Column:
    """Every (band, cell) of that grid which may hold a point within the radius."""
    around, half = band_height(radius_km), reach_in_longitude(lat, radius_km)
    bands = F.sequence(F.floor((lat - around) / height).cast("int"), F.floor((lat + around) / height).cast("int"))

    def squares(b: Column) -> Column:
        n = cells_of_band(b, height, per_circle)
        span = F.sequence(*[F.floor((lon + side) * n / 360).cast("int") for side in (-half, half)])
        return F.transform(F.array_distinct(F.transform(span, lambda c: F.pmod(c, n))), lambda c: F.struct(b.alias("band"), c.alias("cell")))

    return F.flatten(F.transform(bands, squares))


def furthest_km(lat: Column, lon: Column, b: Column, cell: Column, height: float, per_circle: int) -> Column:
    """No point of the square is further away than this from the given one; null if the square or the point lies beyond a pole."""
    n = cells_of_band(b, height, per_circle)
    middle = (cell + 0.5) * 360 / n
    turned = lon + 360 * F.round((middle - lon) / 360)
    dlat = F.greatest(F.abs(lat - b * height), F.abs(lat - (b + 1) * height)) + 1e-9
    dlon = F.least(F.lit(180.0), F.greatest(F.abs(turned - cell * 360 / n), F.abs(turned - (cell + 1) * 360 / n)) + 1e-9)
    widest = F.cos(F.radians(F.greatest(F.lit(0.0), b * height, -(b + 1) * height)))
    chord = F.pow(F.sin(F.radians(dlat / 2)), 2) + F.cos(F.radians(lat)) * widest * F.pow(F.sin(F.radians(dlon / 2)), 2)
    known = (F.abs(lat) <= 90) & (b * height >= -90) & ((b + 1) * height <= 90)
    return F.when(known, F.lit(EARTH_RADIUS_KM) * 2 * F.asin(F.sqrt(F.least(F.lit(1.0), chord))))


def bands_within(lat: Column, radius_km: float) -> Column:
    """Every band that may hold a point within the radius."""
    b = band(lat, radius_km)
    return F.sequence(b - 1, b + 1)


def reach_in_longitude(lat: Column, radius_km: float) -> Column:
    """Largest longitude difference of a point within the radius, in degrees.

    The widest longitude difference on a circle of angular radius a around latitude
    p is asin(sin a / cos p); a circle that reaches a pole covers all longitudes.
    """
    reach = math.sin(radius_km / EARTH_RADIUS_KM)
    polar = F.abs(lat) + band_height(radius_km) >= 90
    return F.when(polar, 180.0).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), F.lit(reach) / F.cos(F.radians(lat))))) + 1e-9
    )


def cells_within(lat: Column, lon: Column, radius_km: float) -> Column:
    """Every cell that may hold a point within the radius."""
    half = reach_in_longitude(lat, radius_km)
    span = F.sequence(cell_at(lon - half, radius_km), cell_at(lon + half, radius_km))
    return F.array_distinct(F.transform(span, lambda c: wrapped(c, radius_km)))


def squares_along(lat: tuple[Column, Column], lon: tuple[Column, Column], radius_km: float) -> Column:
    """Every (band, cell) that a straight track from the first to the second coordinates may touch, cells not wrapped.

    The track is cut into parts no longer than a square; each touches the few squares between its ends.
    """
    height, width = band_height(radius_km), cell_width(radius_km)
    parts = F.greatest(F.lit(1), F.ceil(F.abs(lat[1] - lat[0]) / height), F.ceil(F.abs(lon[1] - lon[0]) / width))

    def between(ends: tuple[Column, Column], k: Column, size: float) -> Column:
        places = [along(*ends, (k + step) / parts) for step in (0, 1)]
        low, high = F.least(*places) - 1e-9, F.greatest(*places) + 1e-9
        return F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))

    def squares(k: Column) -> Column:
        cells = between(lon, k, width)
        return F.flatten(F.transform(between(lat, k, height), lambda b: F.transform(cells, lambda c: F.struct(b.alias("band"), c.alias("cell")))))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1), squares)))
