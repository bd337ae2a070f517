"""Wall-clock parsing, storm-hour alignment and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_time(hhmm: Column) -> Column:
    """``HH:mm:ss`` of an HHMM number (905, 905.0, '0905'); NULL if not a time of day.

    Compared as text rather than parsed: a failed timestamp parse raises inside Spark,
    once per bad row, and costs far more.
    """
    number = hhmm.try_cast("int")
    text = F.lpad(number.cast("string"), 4, "0")
    hours, minutes = text.substr(1, 2), text.substr(3, 2)
    valid = (number >= 0) & (hours < "24") & (minutes < "60")
    return F.when(valid, F.concat(hours, F.lit(":"), minutes, F.lit(":00")))


def stamp(yearmonth: Column, day: Column, hhmm: Column) -> Column:
    """Timestamp of a yyyyMM number, a day and an HHMM number; NULL if it does not exist."""
    text = F.concat(
        yearmonth.cast("string"),
        F.lpad(day.cast("string"), 2, "0"),
        F.lpad(hhmm.cast("string"), 4, "0"),
    )
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmm"))


def hour_before(ts: Column) -> Column:
    """Last full hour strictly before ``ts`` (minute precision): 10:15 → 10:00, 10:00 → 09:00."""
    return F.date_trunc("hour", ts - F.make_interval(mins=F.lit(1)))


def hour_after(ts: Column) -> Column:
    """First full hour strictly after ``ts``: 10:15 → 11:00, 10:00 → 11:00."""
    return F.date_trunc("hour", ts + F.make_interval(hours=F.lit(1)))


def hours_between(begin: Column, end: Column) -> Column:
    """Whole hours from ``begin`` to ``end``, truncated toward zero; negative if reversed."""
    return ((F.unix_timestamp(end) - F.unix_timestamp(begin)) / 3600).cast("int")


def month_of(yearmonth: Column) -> Column:
    """Month of a yyyyMM number."""
    return (yearmonth % 100).cast("int")
