"""Reading bronze files, and choosing them by what their names say."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlens import schemas
from flightlens.operators.combine import one_per_key, union_all
from flightlens.schemas import PERIOD
from flightlens.sources import catalog, listing, sink

# Patterns of bronze file names without ``.parquet``; the groups are
# year and month, or the date.
FLIGHT_FILES = r"(\d{4})_(\d{1,2})_aotd"
STORM_FILES = r"(\d{4})_(\d{1,2})"
AIRPORT_FILES = r"airport|L_AIRPORT_ID"
MONTH_FOLDERS = rf"{PERIOD[0]}=(\d+)/{PERIOD[1]}=(\d+)"
AIRCRAFT_FILES = r"plane_registry_(\d{4}-\d{2}-\d{2})"


def storm_csv(spark: SparkSession, path: str, *, corrupt: str | None = None, multiline: bool = True) -> DataFrame:
    """Storm reports as they are published (RFC 4180): texts in quotes may have commas, doubled quotes and line breaks.

    Declared types, so no pass over the data to infer them. ``corrupt`` names one column more: the text of a record that does not fit the columns or
    their types, else null. With line breaks in texts a file is read by one task; ``multiline=False`` splits large files that have none.
    """
    schema = schemas.STORM_CSV + (f", {corrupt} STRING" if corrupt else "")
    reader = spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=multiline)
    return (reader.option("columnNameOfCorruptRecord", corrupt) if corrupt else reader).csv(path)


def registry_csv(spark: SparkSession, path: str, *, infer: bool = True) -> DataFrame:
    """Aircraft registry. Types are inferred, which reads the files twice, or left as text."""
    return spark.read.options(header=True, inferSchema=infer, sep=",", quote='"', escape="\\").csv(path)


def code_csv(spark: SparkSession, path: str) -> DataFrame:
    """Airport code lookup."""
    return spark.read.schema("AIRPORT_ID INT, AIRPORT STRING").option("header", True).csv(path)


def parquet(spark: SparkSession, path: str | Sequence[str], *, schema: str | None = None, merge: bool = False) -> DataFrame:
    """Parquet files, with the stored types given (``schema``) or merged over all files."""
    reader = spark.read.option("mergeSchema", merge)
    paths = [path] if isinstance(path, str) else list(path)
    return (reader.schema(schema) if schema else reader).parquet(*paths)


def weather_keys_physical(spark: SparkSession, path: str) -> DataFrame:
    """The weather columns the views need, read as stored and then given view types.
    Declaring the stored type keeps the vectorised reader on."""
    return parquet(spark, path, schema=schemas.WEATHER_KEYS_PHYSICAL).withColumn(
        "AIRPORT_ID", F.col("AIRPORT_ID").cast("string")
    )


def _months(spark: SparkSession, months: Iterable[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(sorted(set(months)), ", ".join(f"{p} INT" for p in PERIOD))


def named_months(spark: SparkSession, path: str, pattern: str) -> list[tuple[int, int, str, bool]]:
    """(year, month, path, folder) of every file, or folder of part files, whose name holds a month."""
    found = []
    for entry in listing.entries(spark, path):
        text = re.search(pattern, entry.name)
        if text:
            found.append((int(text[1]), int(text[2]), entry.path, entry.folder))
    return sorted(found)


def partition_months(spark: SparkSession, path: str) -> list[tuple[int, int, str, bool]]:
    """(year, month, path, True) of the partition folders of a monthly table."""
    found = []
    for entry in listing.entries(spark, path):
        if text := re.search(rf"/{MONTH_FOLDERS}$", entry.path):
            found.append((int(text[1]), int(text[2]), entry.path, True))
    return sorted(found)


def bronze_periods(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Distinct (year, month) found in file names."""
    return _months(spark, (m[:2] for m in named_months(spark, path, pattern)))


def stored_periods(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (year, month) of the partition folders of a table."""
    return _months(spark, (m[:2] for m in partition_months(spark, path)))


def processed_periods(spark: SparkSession, path: str) -> DataFrame:
    """Months a table has, and months that were processed but gave no row."""
    stored, empty = stored_periods(spark, path), f"{path}/{sink.PROCESSED}"
    return stored.union(spark.read.parquet(empty).select(*PERIOD)).distinct() if listing.exists(spark, empty) else stored


def common_type(types: Sequence[T.DataType]) -> T.DataType:
    """A type that holds every value of the given ones: themselves, a wider number, or text."""
    if len(set(types)) == 1:
        return types[0]
    if all(isinstance(t, T.IntegralType) for t in types):
        return T.LongType()
    return T.DoubleType() if all(isinstance(t, T.NumericType) for t in types) else T.StringType()


def by_schema(spark: SparkSession, paths: Sequence[str]) -> list[tuple[T.StructType, list[str]]]:
    """Files grouped by their own columns and types. Every part file of a folder counts; a folder stays whole if
    all its files agree, else its files are listed. Footers are read in parallel without a Spark job; one small job for each
    kind of footer turns it into Spark's types."""
    parts = dict(zip(paths, listing.part_files(spark, paths), strict=True))
    files = [file for found in parts.values() for file in found or []]
    kind = dict(zip(files, listing.stored_columns(spark, files), strict=True))
    kinds: dict[str, list[str]] = {}
    for path, found in parts.items():
        own = {kind[file] for file in found or []}
        if len(own) > 1:
            for file in found:
                kinds.setdefault(kind[file], []).append(file)
        else:
            kinds.setdefault(own.pop() if own else path, []).append(path)
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for group in kinds.values():
        schema = spark.read.parquet(group[0]).schema
        groups.setdefault(schema.json(), (schema, []))[1].extend(group)
    return list(groups.values())


def with_all_columns(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """The same frames, each with the columns that only others have, as NULL."""
    types: dict[str, list[T.DataType]] = {}
    for df in frames:
        for field in df.schema:
            types.setdefault(field.name, []).append(field.dataType)
    absent = {n: F.lit(None).cast(common_type(t)) for n, t in types.items()}
    return [df.withColumns({n: c for n, c in absent.items() if n not in df.columns}) for df in frames]


def read_files(spark: SparkSession, paths: Sequence[str], add: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Rows of exactly these files, by column name. Files may differ in columns and types:
    each is read with its own, then brought to a common type. ``add`` sees each group as read."""
    frames = with_all_columns([add(spark.read.schema(schema).parquet(*group)) for schema, group in by_schema(spark, paths)])
    types = {n: common_type([df.schema[n].dataType for df in frames]) for n in frames[0].columns}
    return union_all([df.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in types.items()]) for df in frames])


@contextmanager
def month_frames(spark: SparkSession, path: str, months: Sequence[tuple[int, int, str, bool]], pattern: str) -> Iterator[list[DataFrame]]:
    """Monthly files as frames with the month of the file, a few for each kind of schema.

    Folders become partitions of a table that exists inside the ``with`` block only: the
    month is constant per file, pruned by the planner, free per row. Plain files, and the files of a folder that do not agree, take the
    month from their names. All frames have the same columns; types are the files' own.
    """
    month_of = {m[2]: m for m in months}
    with ExitStack() as open_tables:
        frames = []
        for schema, group in by_schema(spark, list(month_of)):
            turns: dict[int, list] = {}  # a table holds one folder per month
            seen: Counter = Counter()
            for p in group:
                if p in month_of and month_of[p][3]:
                    turns.setdefault(seen[month_of[p][:2]], []).append(month_of[p][:3])
                    seen[month_of[p][:2]] += 1
            frames += [open_tables.enter_context(months_as_table(spark, path, turn, schema)) for turn in turns.values()]
            single = [p for p in group if p in month_of and not month_of[p][3]]
            inside = [p for p in group if p not in month_of]
            dated = [p for p in inside if re.search(rf"/{MONTH_FOLDERS}/[^/]+$", p)]
            named = sorted(set(inside) - set(dated))
            for files, names, first, last in ((single, pattern, -1, 1), (named, pattern, -2, 1), (dated, MONTH_FOLDERS, -3, 2)):
                if files:
                    frames.append(_months_of_files(spark.read.schema(schema).parquet(*files), names, first, last))
        yield with_all_columns(frames)


def _months_of_files(rows: DataFrame, pattern: str, first: int, count: int) -> DataFrame:
    """The month of each row's file, from ``count`` names of its path, ``first`` from the end."""
    names = F.slice(F.split(F.col("_metadata.file_path"), "/"), first, count)
    name = F.regexp_replace(F.array_join(names, "/"), rf"{re.escape(listing.SUFFIX)}$", "")
    return rows.withColumns({p: F.regexp_extract(name, pattern, k).cast("int") for k, p in enumerate(PERIOD, 1)})


@contextmanager
def months_as_table(spark: SparkSession, path: str, months: Sequence[tuple[int, int, str]], schema: T.StructType) -> Iterator[DataFrame]:
    """Monthly folders of one schema as partitions of an external table; dropping it leaves the files."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    name = f"flightlens_months_{uuid.uuid4().hex}"
    catalog.create_external(spark, name, columns, path, monthly=True)
    try:
        catalog.add_months(spark, name, months)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def named_files(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Paths of the files whose name matches."""
    return [e.path for e in listing.entries(spark, path) if re.search(pattern, e.name)]


def read_named(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Rows of every file whose name matches: a union of many files by column name."""
    paths = named_files(spark, path, pattern)
    if not paths:
        raise FileNotFoundError(f"no file under {path} matches {pattern}")
    return read_files(spark, paths)


def registry_snapshots(spark: SparkSession, path: str) -> DataFrame | None:
    """Every registry copy with its date as ``snapshot_date``: files and folders named by date,
    and the partitions of ``sink.write_dated_snapshot``. None if there is neither."""

    def dated(df: DataFrame) -> DataFrame:
        where = F.col("_metadata.file_path")
        date = F.regexp_extract(where, rf"(?:{AIRCRAFT_FILES}|/snapshot_date=(\d{{4}}-\d{{2}}-\d{{2}})/)", 0)
        return df.withColumn("snapshot_date", F.regexp_extract(date, r"\d{4}-\d{2}-\d{2}", 0).try_cast("date"))

    found = [e.path for e in listing.entries(spark, path) if re.search(AIRCRAFT_FILES, e.name) or e.name.startswith("snapshot_date=")]
    return read_files(spark, found, dated) if found else None


def airport_reference(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """Airport coordinates for the storm join, one row per airport, optionally one country."""
    rows = read_named(spark, path, AIRPORT_FILES)
    rows = rows.withColumn("AIRPORT_ID", F.col("AIRPORT_ID").try_cast("int"))
    if country is not None:
        rows = rows.filter(F.col("AIRPORT_COUNTRY_NAME") == country)
    return one_per_key(rows, "AIRPORT_ID")
