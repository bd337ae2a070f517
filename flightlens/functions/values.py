"""Clamps, flags, code lookups, buckets, lenient parsing and text rendering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_negative(col: Column) -> Column:
    """Whole minutes, truncated toward zero; a missing or negative value is 0."""
    return F.coalesce(F.greatest(col.try_cast("double"), F.lit(0.0)).try_cast("int"), F.lit(0))


def non_negative_or_null(col: Column) -> Column:
    """As ``non_negative``, but a missing value stays missing."""
    minutes = col.try_cast("double")
    return F.when(minutes.isNotNull(), F.greatest(minutes, F.lit(0.0)).try_cast("int"))


def flag(col: Column) -> Column:
    """Boolean from a 0/1 number, numeric text (``'1.00'``) or boolean text; else NULL."""
    return F.coalesce(col.try_cast("double").cast("boolean"), col.try_cast("boolean"))


def decode(col: Column, names: Mapping, default=None) -> Column:
    """Name of a code. Codes are compared as trimmed text, so a numeric column works too."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), F.trim(col.cast("string")))
    return found if default is None else F.coalesce(found, F.lit(default))


def bucket(col: Column, bounds: Sequence[tuple], otherwise: str) -> Column:
    """Label of the inclusive range a value falls in; an upper bound of None is open."""
    label = None
    for name, low, high in bounds:
        inside = col >= low if high is None else col.between(low, high)
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return label.otherwise(otherwise)


def safe_float(col: Column) -> Column:
    """Number held in text, else NULL."""
    return F.trim(col).try_cast("double")


def safe_int(col: Column) -> Column:
    """Whole part of a number held in text (``'12.0'`` → 12), else NULL."""
    return safe_float(col).try_cast("bigint")


def percent(part: Column, whole: Column, digits: int = 3) -> Column:
    """``part`` of ``whole`` on a 0-100 scale, rounded half up; NULL if ``whole`` is 0."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def rounded(col: Column, digits: int) -> Column:
    """``F.round`` of a double, for very many rows: Spark writes each value as decimal text and reads it again. That is left to values
    near a tie, and to large ones, where the product below is no longer exact enough; the result is the same to the last bit."""
    scale = F.lit(float(10**digits))
    whole = F.rint(col * scale)
    plain = (F.abs(col * scale - whole) < 0.499) & (F.abs(col) < 1e6)
    return F.when(plain, whole / scale + 0.0).otherwise(F.round(col, digits))


def as_text(col: Column, type_name: str) -> Column:
    """A value as the text kept in a key-value cell.

    Numbers are plain decimals between 1e-4 and 1e16 and use a signed two-digit
    exponent outside, e.g. ``0.0005`` and ``1e-05``; Spark's own text for these is
    ``5.0E-4`` and ``1.0E-5``. Booleans are capitalised.
    """
    text = col.cast("string")
    if type_name == "boolean":
        return F.initcap(text)
    if type_name not in ("double", "float"):
        return text
    size = F.abs(col)
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(.*)E", 1), r"\.0$", "")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    return (
        F.when(F.isnan(col), "nan")
        .when(size == float("inf"), F.when(col > 0, "inf").otherwise("-inf"))
        .when(~text.contains("E"), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )
