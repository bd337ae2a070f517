"""Declared schemas, as DDL strings. Column names and types are fixed values of the data."""

STORM_CSV = """
BEGIN_YEARMONTH INT, BEGIN_DAY INT, BEGIN_TIME INT,
END_YEARMONTH INT, END_DAY INT, END_TIME INT,
EPISODE_ID INT, EVENT_ID INT, STATE STRING, STATE_FIPS INT, YEAR INT, MONTH_NAME STRING,
EVENT_TYPE STRING, CZ_TYPE STRING, CZ_FIPS INT, CZ_NAME STRING, WFO STRING,
BEGIN_DATE_TIME STRING, CZ_TIMEZONE STRING, END_DATE_TIME STRING,
INJURIES_DIRECT INT, INJURIES_INDIRECT INT, DEATHS_DIRECT INT, DEATHS_INDIRECT INT,
DAMAGE_PROPERTY STRING, DAMAGE_CROPS STRING, SOURCE STRING,
MAGNITUDE DOUBLE, MAGNITUDE_TYPE STRING, FLOOD_CAUSE STRING, CATEGORY STRING,
TOR_F_SCALE STRING, TOR_LENGTH DOUBLE, TOR_WIDTH INT, TOR_OTHER_WFO STRING,
TOR_OTHER_CZ_STATE STRING, TOR_OTHER_CZ_FIPS INT, TOR_OTHER_CZ_NAME STRING,
BEGIN_RANGE INT, BEGIN_AZIMUTH STRING, BEGIN_LOCATION STRING,
END_RANGE INT, END_AZIMUTH STRING, END_LOCATION STRING,
BEGIN_LAT DOUBLE, BEGIN_LON DOUBLE, END_LAT DOUBLE, END_LON DOUBLE,
EPISODE_NARRATIVE STRING, EVENT_NARRATIVE STRING, DATA_SOURCE STRING
"""

FLIGHT_FACTS = """
FactID BIGINT, DepartureAirportID INT, ArrivalAirportID INT, CarrierCode STRING,
IsCancelledFlag BOOLEAN, CancellationReasonName STRING,
ScheduledDepartureTime STRING, DepartureDelay INT, DepartureTimeBlock STRING,
ScheduledArrivalTime STRING, ArrivalDelay INT, ArrivalTimeBlock STRING,
IsDivertedFlag BOOLEAN, TailNumber STRING
"""

AIRPORT_DIM = """
AirportID INT, AirportStateName STRING, AirportName STRING, AirportCityName STRING,
Latitude FLOAT, Longitude FLOAT
"""

AIRCRAFT_DIM = """
TailNum STRING, ManufacturerName STRING, ModelName STRING,
AircraftTypeName STRING, EngineTypeName STRING, YearManufactured INT
"""

WEATHER_EVENTS = """
ORIGINAL_WEATHER_INDEX BIGINT, DATETIME TIMESTAMP,
WEATHER_LATITUDE DOUBLE, WEATHER_LONGITUDE DOUBLE, EVENT_TYPE STRING, EVENT_CATEGORY_ID INT,
BEGIN_DATETIME TIMESTAMP, END_DATETIME TIMESTAMP, HOUR_OFFSET INT, INTERPOLATION_FACTOR DOUBLE,
AIRPORT_ID INT, DISPLAY_AIRPORT_NAME STRING, AIRPORT_COUNTRY_NAME STRING,
AIRPORT_LATITUDE DOUBLE, AIRPORT_LONGITUDE DOUBLE, DISTANCE_KM DOUBLE
"""

# The four columns the weather views need, typed as stored on disk.
WEATHER_KEYS_PHYSICAL = "AIRPORT_ID INT, EVENT_TYPE STRING, year_partition INT, month_partition INT"

# Types the views expect of the flight table (identifiers as text).
FLIGHT_VIEW_TYPES = {
    "DepartureAirportID": "string",
    "ArrivalAirportID": "string",
    "CarrierCode": "string",
    "IsCancelledFlag": "boolean",
    "DepartureDelay": "int",
    "ArrivalDelay": "int",
    "year_partition": "int",
    "month_partition": "int",
    "TailNumber": "string",
}

PERIOD = ["year_partition", "month_partition"]
