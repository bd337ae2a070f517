"""Airport and aircraft tables, profiles and incremental inserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightlens.codes import AIRCRAFT_TYPES, ENGINE_TYPES
from flightlens.operators.aggregate import group_count
from flightlens.operators.combine import new_keys_only, union_all
from flightlens.plans import dimensions as dims
from flightlens.registry.query import case_of, part, query

part(
    "airports",
    ("fx_airports",),
    """SELECT DISTINCT AIRPORT_ID AS AirportID, trim(AIRPORT_STATE_NAME) AS AirportStateName,
 trim(DISPLAY_AIRPORT_NAME) AS AirportName, trim(DISPLAY_AIRPORT_CITY_NAME_FULL) AS AirportCityName,
 CAST(LATITUDE AS FLOAT) AS Latitude, CAST(LONGITUDE AS FLOAT) AS Longitude FROM fx_airports""",
)
part(
    "aircraft",
    ("fx_aircraft",),
    f"""SELECT DISTINCT 'N' || trim(N_NUMBER) AS TailNum, trim(MFR) AS ManufacturerName, trim(MODEL) AS ModelName,
 {case_of("trim(TYPE_AIRCRAFT)", AIRCRAFT_TYPES)} AS AircraftTypeName,
 {case_of("trim(TYPE_ENGINE)", ENGINE_TYPES)} AS EngineTypeName,
 TRY_CAST(trim(YEAR_MFR) AS INT) AS YearManufactured FROM fx_aircraft""",
)


@query("SELECT * FROM airports", "airports")
def airport_dim(t):
    return dims.airport_dim(union_all([t.airports, t.airports]))


@query("SELECT * FROM aircraft", "aircraft")
def aircraft_dim(t):
    return dims.aircraft_dim(union_all([t.aircraft, t.aircraft]))


@query(
    f"""SELECT N_NUMBER, {case_of("trim(TYPE_AIRCRAFT)", AIRCRAFT_TYPES, "'Unknown'")} AS aircraft_type,
 {case_of("trim(TYPE_ENGINE)", ENGINE_TYPES, "'Invalid'")} AS engine_type FROM fx_aircraft""",
    "fx_aircraft",
)
def aircraft_bronze_codes(t):
    return dims.decoded_registry(t.aircraft).select("N_NUMBER", "aircraft_type", "engine_type")


@query(
    """SELECT 'N' || N_NUMBER AS TailNum, TYPE_AIRCRAFT AS ManufacturerName, TYPE_ENGINE AS ModelName FROM fx_aircraft""",
    "fx_aircraft",
)
def aircraft_code_columns(t):
    """Maker and model taken from code columns."""
    out = dims.aircraft_dim(t.aircraft, maker="TYPE_AIRCRAFT", model="TYPE_ENGINE")
    return out.select("TailNum", "ManufacturerName", "ModelName")


@query(
    """SELECT count(*) AS total_airports, count(DISTINCT AirportStateName) AS unique_states,
 count(DISTINCT AirportCityName) AS unique_cities, min(Latitude) AS min_latitude, min(Longitude) AS min_longitude,
 max(Latitude) AS max_latitude, max(Longitude) AS max_longitude FROM airports""",
    "airports",
)
def airport_profile(t):
    return dims.airport_profile(dims.airport_dim(t.airports))


@query(
    """SELECT count(*) AS total_aircraft, count(DISTINCT ManufacturerName) AS unique_manufacturers,
 count(DISTINCT AircraftTypeName) AS aircraft_types, count(DISTINCT EngineTypeName) AS engine_types,
 min(YearManufactured) AS oldest_year, max(YearManufactured) AS newest_year FROM aircraft""",
    "aircraft",
)
def aircraft_profile(t):
    return dims.aircraft_profile(dims.aircraft_dim(t.aircraft))


@query(
    """SELECT AirportStateName, count(*) AS airport_count FROM airports GROUP BY 1
 ORDER BY airport_count DESC, AirportStateName LIMIT 10""",
    "airports",
)
def top_states(t):
    return dims.top_states(dims.airport_dim(t.airports))


@query("SELECT AirportStateName, count(*) AS airport_count FROM airports GROUP BY 1", "airports")
def airports_per_state(t):
    return group_count(dims.airport_dim(t.airports), "AirportStateName", "airport_count")


@query(
    """SELECT * FROM airports n WHERE AirportID IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM fx_airport_codes c WHERE c.AIRPORT_ID = n.AirportID)""",
    "airports",
    "fx_airport_codes",
)
def dim_insert_new(t):
    """Airports not stored yet; the code table stands for the stored keys."""
    stored = t.airport_codes.select(F.col("AIRPORT_ID").alias("AirportID"))
    with_null = stored.unionByName(stored.limit(1).select(F.lit(None).cast("int").alias("AirportID")))
    return new_keys_only(dims.airport_dim(t.airports), with_null, "AirportID")
