"""Flight facts from raw on-time records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.codes import CANCELLATION_REASONS
from flightlens.functions.keys import content_id, load_id
from flightlens.functions.times import clock_time
from flightlens.functions.values import decode, flag, non_negative, non_negative_or_null
from flightlens.operators.checks import cast_columns, present, require_columns
from flightlens.schemas import FLIGHT_VIEW_TYPES, PERIOD


def flight_facts(raw: DataFrame, *, ids: str = "load", keep: Sequence[str] = ()) -> DataFrame:
    """One typed fact per raw record: a single projection, no shuffle.

    A cancelled flight has no delay. Its departure delay counts as 0 in averages; its
    arrival delay is missing and is left out. ``ids="content"`` gives identifiers that
    do not depend on the file layout. ``keep`` carries further raw columns along.
    """
    c = F.col
    fact_id = load_id() if ids == "load" else content_id(*[c(f"`{n}`") for n in raw.columns])
    return raw.select(
        fact_id.alias("FactID"),
        c("ORIGIN_AIRPORT_ID").try_cast("int").alias("DepartureAirportID"),
        c("DEST_AIRPORT_ID").try_cast("int").alias("ArrivalAirportID"),
        c("OP_CARRIER").alias("CarrierCode"),
        flag(c("CANCELLED")).alias("IsCancelledFlag"),
        decode(c("CANCELLATION_CODE"), CANCELLATION_REASONS).alias("CancellationReasonName"),
        clock_time(c("CRS_DEP_TIME")).alias("ScheduledDepartureTime"),
        non_negative(c("DEP_DELAY")).alias("DepartureDelay"),
        c("DEP_TIME_BLK").alias("DepartureTimeBlock"),
        clock_time(c("CRS_ARR_TIME")).alias("ScheduledArrivalTime"),
        non_negative_or_null(c("ARR_DELAY")).alias("ArrivalDelay"),
        c("ARR_TIME_BLK").alias("ArrivalTimeBlock"),
        flag(c("DIVERTED")).alias("IsDivertedFlag"),
        c("TAIL_NUM").alias("TailNumber"),
        c("YEAR").try_cast("int").alias("year_partition"),
        c("MONTH").try_cast("int").alias("month_partition"),
        *keep,
    )


def normalized_flights(facts: DataFrame) -> DataFrame:
    """The columns the views use, in fixed types, without rows that lack a view key."""
    require_columns(facts, list(FLIGHT_VIEW_TYPES), "flight_facts")
    return with_view_keys(cast_columns(facts, FLIGHT_VIEW_TYPES))


def with_view_keys(facts: DataFrame) -> DataFrame:
    return present(facts, "DepartureAirportID", *PERIOD)
