"""Flight facts and schema normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightlens.codes import CANCELLATION_REASONS
from flightlens.operators.checks import clean_names
from flightlens.operators.combine import union_all
from flightlens.plans.flights import flight_facts as facts_of
from flightlens.plans.flights import normalized_flights as normalize
from flightlens.registry.query import case_of, part, query


def clock(column: str) -> str:
    return f"""CASE WHEN {column} >= 0 AND {column} // 100 < 24 AND {column} % 100 < 60
 THEN lpad(CAST({column} // 100 AS VARCHAR), 2, '0') || ':' || lpad(CAST({column} % 100 AS VARCHAR), 2, '0') || ':00' END"""


part(
    "facts",
    ("fx_flights",),
    f"""SELECT ORIGIN_AIRPORT_ID AS DepartureAirportID, DEST_AIRPORT_ID AS ArrivalAirportID, OP_CARRIER AS CarrierCode,
 CANCELLED <> 0 AS IsCancelledFlag, {case_of("CANCELLATION_CODE", CANCELLATION_REASONS)} AS CancellationReasonName,
 {clock("CRS_DEP_TIME")} AS ScheduledDepartureTime,
 CAST(CASE WHEN DEP_DELAY IS NULL OR DEP_DELAY < 0 THEN 0 ELSE trunc(DEP_DELAY) END AS INT) AS DepartureDelay,
 DEP_TIME_BLK AS DepartureTimeBlock, {clock("CRS_ARR_TIME")} AS ScheduledArrivalTime,
 CAST(CASE WHEN ARR_DELAY < 0 THEN 0 ELSE trunc(ARR_DELAY) END AS INT) AS ArrivalDelay,
 ARR_TIME_BLK AS ArrivalTimeBlock, DIVERTED <> 0 AS IsDivertedFlag, TAIL_NUM AS TailNumber,
 YEAR AS year_partition, MONTH AS month_partition FROM fx_flights""",
)


@query("SELECT * FROM facts", "facts")
def flight_facts(t):
    return facts_of(t.flights).drop("FactID")


@query(
    """SELECT CAST(DepartureAirportID AS VARCHAR) AS DepartureAirportID, CAST(ArrivalAirportID AS VARCHAR) AS ArrivalAirportID,
 CarrierCode, IsCancelledFlag, DepartureDelay, ArrivalDelay, year_partition, month_partition, TailNumber
 FROM facts WHERE DepartureAirportID IS NOT NULL AND year_partition IS NOT NULL AND month_partition IS NOT NULL""",
    "facts",
)
def normalized_flights(t):
    return normalize(facts_of(t.flights))


@query(
    """SELECT DATE_ID, CancellationReasonName, count(*) AS n FROM
 (SELECT YEAR * 100 + MONTH AS DATE_ID, {reason} AS CancellationReasonName FROM fx_flights) GROUP BY ALL""".replace(
        "{reason}", case_of("CANCELLATION_CODE", CANCELLATION_REASONS)
    ),
    "fx_flights",
)
def facts_with_date_id(t):
    """A raw date identifier carried through, as older fact tables had it."""
    raw = t.flights.withColumn("DATE_ID", F.expr("YEAR * 100 + MONTH"))
    return facts_of(raw, keep=["DATE_ID"]).groupBy("DATE_ID", "CancellationReasonName").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) AS ids FROM fx_flights", "fx_flights")
def fact_ids(t):
    """Identifiers of one load: as many as there are rows."""
    return facts_of(t.flights).agg(F.count("*").alias("n"), F.count_distinct("FactID").alias("ids"))


@query(
    "SELECT count(*) AS ids FROM (SELECT DISTINCT * FROM fx_flights)",
    "fx_flights",
)
def fact_ids_content(t):
    """Identifiers by content: as many as there are distinct rows."""
    return facts_of(t.flights, ids="content").agg(F.count_distinct("FactID").alias("ids"))


@query(
    """SELECT AIRPORT_ID, AIRPORT_COUNTRY_NAME, NULL AS AIRPORT FROM fx_airports
 UNION ALL SELECT AIRPORT_ID, NULL, AIRPORT FROM fx_airport_codes""",
    "fx_airports",
    "fx_airport_codes",
)
def union_by_name(t):
    return union_all([t.airports.select("AIRPORT_ID", "AIRPORT_COUNTRY_NAME"), t.airport_codes])


@query(
    """SELECT N_NUMBER AS "N-NUMBER", TYPE_AIRCRAFT, YEAR_MFR AS YEAR_MFR FROM fx_aircraft""",
    "fx_aircraft",
)
def clean_column_names(t):
    raw = t.aircraft.select("N_NUMBER", "TYPE_AIRCRAFT", "YEAR_MFR")
    return clean_names(raw.toDF("N-NUMBER", "TYPE AIRCRAFT", "YEAR\t MFR;"))
