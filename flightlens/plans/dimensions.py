"""Airport and aircraft tables, their profiles, and their insert-only refresh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.codes import AIRCRAFT_TYPES, ENGINE_TYPES
from flightlens.functions.values import decode
from flightlens.operators.aggregate import profile, top_groups
from flightlens.operators.combine import new_keys_only, one_per_key
from flightlens.sources.sink import write_snapshot


def airport_dim(raw: DataFrame, prefer: Sequence[str] = ()) -> DataFrame:
    """One row per airport; texts trimmed, coordinates stored as float."""
    c = F.col
    out = raw.select(
        c("AIRPORT_ID").try_cast("int").alias("AirportID"),
        F.trim("AIRPORT_STATE_NAME").alias("AirportStateName"),
        F.trim("DISPLAY_AIRPORT_NAME").alias("AirportName"),
        F.trim("DISPLAY_AIRPORT_CITY_NAME_FULL").alias("AirportCityName"),
        c("LATITUDE").try_cast("float").alias("Latitude"),
        c("LONGITUDE").try_cast("float").alias("Longitude"),
        *prefer,
    )
    return one_per_key(out, "AirportID", prefer).drop(*prefer)


def registry_columns(raw: DataFrame) -> DataFrame:
    """Registry columns with one spelling: ``N-NUMBER`` and ``YEAR MFR`` → ``N_NUMBER``, ``YEAR_MFR``."""
    return raw.toDF(*[name.strip().replace(" ", "_").replace("-", "_") for name in raw.columns])


def decoded_registry(raw: DataFrame) -> DataFrame:
    """Registry rows plus names for both type codes, with a word for unknown codes."""
    names = {n.replace("_", " ").upper(): n for n in raw.columns}
    code = {k: F.col(f"`{names[k]}`") for k in ("TYPE AIRCRAFT", "TYPE ENGINE")}
    return raw.withColumns(
        {
            "aircraft_type": decode(code["TYPE AIRCRAFT"], AIRCRAFT_TYPES, "Unknown"),
            "engine_type": decode(code["TYPE ENGINE"], ENGINE_TYPES, "Invalid"),
        }
    )


def aircraft_dim(
    raw: DataFrame,
    *,
    maker: str = "MFR",
    model: str = "MODEL",
    prefer: Sequence[str] = (),
    trim_key: bool = True,
) -> DataFrame:
    """One row per tail number. ``maker`` and ``model`` may name the code columns instead;
    ``prefer`` (e.g. ``snapshot_date``) decides which copy of a tail number stays."""
    c = F.col
    raw = registry_columns(raw)
    number = F.trim("N_NUMBER") if trim_key else c("N_NUMBER")
    out = raw.select(
        F.concat(F.lit("N"), number).alias("TailNum"),
        F.trim(maker).alias("ManufacturerName"),
        F.trim(model).alias("ModelName"),
        decode(c("TYPE_AIRCRAFT"), AIRCRAFT_TYPES).alias("AircraftTypeName"),
        decode(c("TYPE_ENGINE"), ENGINE_TYPES).alias("EngineTypeName"),
        c("YEAR_MFR").try_cast("int").alias("YearManufactured"),
        *prefer,
    )
    return one_per_key(out, "TailNum", prefer).drop(*prefer)


def refresh_dimension(incoming: DataFrame, existing: DataFrame | None, path: str, key: str, mode: str = "insert_new") -> None:
    """Store a dimension. ``insert_new`` adds unseen keys and never changes a stored row;
    ``full`` replaces the table."""
    if mode not in ("insert_new", "full"):
        raise ValueError(f"mode must be 'insert_new' or 'full', not {mode!r}")
    if mode == "full" or existing is None:
        write_snapshot(incoming, path)
    else:
        write_snapshot(new_keys_only(incoming, existing, key), path, "append")


def airport_profile(airports: DataFrame) -> DataFrame:
    return profile(
        airports,
        "total_airports",
        distinct={"unique_states": "AirportStateName", "unique_cities": "AirportCityName"},
        least={"min_latitude": "Latitude", "min_longitude": "Longitude"},
        most={"max_latitude": "Latitude", "max_longitude": "Longitude"},
    )


def aircraft_profile(aircraft: DataFrame) -> DataFrame:
    return profile(
        aircraft,
        "total_aircraft",
        distinct={
            "unique_manufacturers": "ManufacturerName",
            "aircraft_types": "AircraftTypeName",
            "engine_types": "EngineTypeName",
        },
        least={"oldest_year": "YearManufactured"},
        most={"newest_year": "YearManufactured"},
    )


def top_states(airports: DataFrame, n: int = 10) -> DataFrame:
    """States with most airports."""
    return top_groups(airports, "AirportStateName", n, count_as="airport_count")
