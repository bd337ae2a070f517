"""Views as keyed rows, and the lookups over them.

A keyed row is ``(rowkey STRING, cells MAP<STRING, STRING>)``: text values, missing
values absent. A lookup filters ``rowkey`` by equality or prefix, which Parquet can use
to skip data, and parses the cells it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightlens.codes import AGE_ORDER
from flightlens.functions.keys import key_parts, row_key, year_month, year_text
from flightlens.functions.values import as_text, safe_float, safe_int
from flightlens.operators.combine import label
from flightlens.operators.reshape import declared_order, dense_axis, matrix, rows_from
from flightlens.plans.views import AIRPORT, CARRIER, VIEWS
from flightlens.schemas import PERIOD


def _by_month(*parts: str) -> Callable[[str], Column]:
    def key(on_null: str) -> Column:
        month = year_month(*[F.col(p) for p in PERIOD])
        return row_key(*[F.col(p) for p in parts], month, required=[month], on_null=on_null)

    return key


def _by_age(on_null: str) -> Column:
    year = year_text(F.col("flight_year"))
    return row_key(year, F.col("aircraft_age_bucket"), F.col(CARRIER), required=[year], on_null=on_null)


# Key layout of each view.
ROW_KEYS = {
    "delay_airport_month": _by_month(AIRPORT),
    "cancel_airport_month": _by_month(AIRPORT),
    "delay_carrier_month": _by_month(CARRIER),
    "top10_airports_delay_month": _by_month(),
    "delay_weather_region_month": _by_month("Region", "EventType"),
    "cancel_weather_region_month": _by_month("Region", "EventType"),
    "aircraft_age_bucket_carrier_year": _by_age,
}


def keyed_rows(df: DataFrame, key: Column, cells: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of a key-value table; a row without key or without any cell is left out. ``keep`` carries columns along."""
    types = dict(df.dtypes)
    # All doubles are written by one expression over an array: plans stay small for wide rows.
    doubles = [c for c in cells if types[c] == "double"]
    others = [c for c in cells if types[c] != "double"]
    written = F.transform(F.array(*doubles).cast("array<double>"), lambda x: as_text(x, "double"))
    texts = F.concat(written, F.array(*[as_text(F.col(c), types[c]) for c in others]).cast("array<string>"))
    names = F.array(*[F.lit(c) for c in [*doubles, *others]])
    present = F.map_filter(F.map_from_arrays(names, texts), lambda _, v: v.isNotNull())
    rows = df.select(key.alias("rowkey"), present.alias("cells"), *keep)
    return rows.filter(F.col("rowkey").isNotNull() & (F.size("cells") > 0))


def keyed_view(name: str, view: DataFrame, on_null: str = "collapse", keep: Sequence[str] = ()) -> DataFrame:
    """A view as keyed rows. A missing region is left out of the key by default; the
    lookups skip such two-part keys. ``on_null="skip"`` does not store them. ``keep``: view columns to be carried along, for a store in partitions."""
    return keyed_rows(view, ROW_KEYS[name](on_null), VIEWS[name].measures, keep)


def in_range(keyed: DataFrame, **bounds: tuple[int, int]) -> DataFrame:
    """Keyed rows of a store in partitions, from the partitions of the range only; other stores as they are."""
    for column, (first, last) in bounds.items():
        if column in keyed.columns:
            keyed = keyed.filter(F.col(column).between(first, last))
    return keyed


def cell_rows(keyed: DataFrame) -> DataFrame:
    """One row per cell."""
    return keyed.select("rowkey", F.explode("cells").alias("qualifier", "value"))


def _number(cell: str) -> Column:
    parse = safe_int if cell.endswith("_cnt") else safe_float
    return parse(F.try_element_at("cells", F.lit(cell))).alias(cell)


def month_series(keyed: DataFrame, entity: str, year: int, first: int, last: int, cells: Sequence[str], *, ordered: bool = True) -> DataFrame:
    """Monthly values of one airport or carrier, for months that have a row."""
    keys = [f"{entity}#{year:04d}{month:02d}" for month in range(first, last + 1)]
    stamp = F.element_at(key_parts(F.col("rowkey")), -1)
    rows = in_range(keyed, year_partition=(year, year), month_partition=(first, last)).filter(F.col("rowkey").isin(keys)).select(
        stamp.substr(1, 4).cast("int").alias("year"), stamp.substr(5, 2).cast("int").alias("month"), *map(_number, cells)
    )
    return rows.orderBy("year", "month") if ordered else rows


def dense_series(series: DataFrame, first: int, last: int, value: str) -> DataFrame:
    """One value for every month of the range, NULL where the series has none."""
    return dense_axis(series.select("month", value), "month", first, last)


def ranking_rows(keyed: DataFrame, year: int | None = None, month: int | None = None, n: int = 10) -> DataFrame:
    """A month's wide ranking as rows of (month key, rank, airport, delay); ranks without
    both are left out. Every month if none is given."""
    if year is not None:
        keyed = in_range(keyed, year_partition=(year, year), month_partition=(month, month)).filter(F.col("rowkey") == f"{year:04d}{month:02d}")
    cell = {
        (i, what): F.try_element_at("cells", F.lit(f"rank{i:02d}_{what}"))
        for i in range(1, n + 1)
        for what in ("airport", "delay")
    }
    places = [(F.lit(i), cell[i, "airport"], safe_float(cell[i, "delay"])) for i in range(1, n + 1)]
    rows = keyed.select("rowkey", rows_from(places, ["rank", "airport_id", "avg_dep_delay"]))
    return rows.filter(F.col("airport_id").isNotNull() | F.col("avg_dep_delay").isNotNull())


def labeled_ranking(ranking: DataFrame, codes: DataFrame) -> DataFrame:
    """Ranking with the airport's code, or its identifier where the lookup has none."""
    return label(ranking, "airport_id", codes, "AIRPORT_ID", "AIRPORT", "AirportCode")


def region_months(keyed: DataFrame, region: str | None, year: int, first: int, last: int, value: str, *, ordered: bool = True) -> DataFrame:
    """One measure per event type and month of a region, found by key prefix (every region
    if None). Keys without three parts or without a readable month are skipped."""
    keyed = in_range(keyed, year_partition=(year, year), month_partition=(first, last))
    if region is not None:
        keyed = keyed.filter(F.col("rowkey").startswith(f"{region}#"))
    parts = key_parts(F.col("rowkey"), 3)
    month_key = F.try_element_at(parts, F.lit(3))
    rows = keyed.filter(F.size(parts) == 3).select(
        F.try_element_at(parts, F.lit(1)).alias("region"),
        F.try_element_at(parts, F.lit(2)).alias("EventType"),
        month_key.substr(1, 4).try_cast("int").alias("year"),
        month_key.substr(5, 2).try_cast("int").alias("month"),
        _number(value),
        _number("flights_cnt"),
    )
    rows = rows.filter((F.col("year") == year) & F.col("month").between(first, last))
    return rows.orderBy("month", "EventType") if ordered else rows


def weather_matrix(rows: DataFrame, value: str, first: int, last: int) -> DataFrame:
    """Event type × month, with every month of the range as a column ``m01`` ..."""
    wide = matrix(rows, "EventType", "month", value, range(first, last + 1), prefix="m")
    return wide.toDF("EventType", *[f"m{month:02d}" for month in range(first, last + 1)])


def month_matrix(rows: DataFrame, value: str, event_types: Sequence[str]) -> DataFrame:
    """The same matrix turned: month × event type."""
    return matrix(rows, "month", "EventType", value, event_types)


def age_rows(keyed: DataFrame, year: int, top_carriers: int | None = 5, *, ordered: bool = True) -> DataFrame:
    """Age buckets of one year for the carriers with most flights, in bucket order."""
    parts = key_parts(F.col("rowkey"))
    rows = in_range(keyed, flight_year=(year, year)).filter(F.col("rowkey").startswith(f"{year:04d}#") & (F.size(parts) == 3)).select(
        F.try_element_at(parts, F.lit(1)).try_cast("int").alias("year"),
        F.try_element_at(parts, F.lit(2)).alias("aircraft_age_bucket"),
        F.try_element_at(parts, F.lit(3)).alias("carrier"),
        *map(_number, ["avg_dep_delay", "avg_arr_delay", "flights_cnt"]),
    )
    if top_carriers:
        # One read: totals and ranks as windows over the year's few rows.
        total = rows.withColumn("_flights", F.sum("flights_cnt").over(Window.partitionBy("carrier")))
        ranked = total.withColumn("_rank", F.dense_rank().over(Window.orderBy(F.desc("_flights"), "carrier")))
        rows = ranked.filter(F.col("_rank") <= top_carriers).drop("_flights", "_rank")
    return rows.orderBy(declared_order("aircraft_age_bucket", AGE_ORDER), "carrier") if ordered else rows


def age_matrix(rows: DataFrame, carriers: Sequence[str]) -> DataFrame:
    """Age bucket × carrier, average departure delay."""
    return matrix(rows, "aircraft_age_bucket", "carrier", "avg_dep_delay", carriers)


def carriers_of(rows: DataFrame, limit: int = 1000) -> list[str]:
    """Carriers in a lookup result, for a matrix header; an error beyond ``limit`` columns."""
    found = [r[0] for r in rows.select("carrier").distinct().orderBy("carrier").limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} carriers: name the columns of the matrix")
    return found
