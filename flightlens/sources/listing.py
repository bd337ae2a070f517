"""What lies in a folder: names only, from any store that Hadoop's file system API reaches.

Monthly files, folders of part files and partition folders are leaves: they are not opened, so
a listing takes one request per folder above them, whatever their size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

SUFFIX = ".parquet"
AT_ONCE = 16
S, T = TypeVar("S"), TypeVar("T")
PARTITION = re.compile(r"(month_partition|snapshot_date)=[^/]+$")


@dataclass(frozen=True, order=True)
class Entry:
    """A Parquet file, a folder of part files, or a partition folder (the last two: ``folder``)."""

    path: str
    folder: bool

    @property
    def name(self) -> str:
        """Without ``.parquet``."""
        return self.path.rsplit("/", 1)[-1].removesuffix(SUFFIX)


def _open(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _open(spark, path)
    return files.exists(place)


def entries(spark: SparkSession, path: str) -> list[Entry]:
    """Leaves under ``path``, in order; none if it is absent. Hidden names are left out."""
    files, place = _open(spark, path)
    if not files.exists(place):
        return []
    found, todo = [], [files.getFileStatus(place)]
    while todo:
        status = todo.pop()
        where = status.getPath().toString()
        if where.endswith(SUFFIX) or status.isDirectory() and PARTITION.search(where):
            found.append(Entry(where, status.isDirectory()))
        elif status.isDirectory():
            todo += [s for s in files.listStatus(status.getPath()) if s.getPath().getName()[0] not in "_."]
    return sorted(found)


def files_of(df: DataFrame) -> list[str]:
    """Paths of all files a scan would read, from one listing that Spark spreads over tasks; no file is opened."""
    return sorted(df.inputFiles())


def each(work: Callable[[S], T], items: Sequence[S]) -> list[T]:
    """``work`` for each item, by ``AT_ONCE`` threads of this process. No Spark job is run."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(work, items))


def part_files(spark: SparkSession, paths: Sequence[str]) -> list[list[str] | None]:
    """For each path the Parquet files in it: itself if it is a file, None if it has folders of its own."""

    def parts(path: str) -> list[str] | None:
        files, place = _open(spark, path)
        if files.getFileStatus(place).isFile():
            return [path]
        found = [s for s in files.listStatus(place) if s.getPath().getName()[0] not in "_."]
        if any(s.isDirectory() for s in found):
            return None
        return sorted(name for name in (s.getPath().toString() for s in found) if name.endswith(SUFFIX))

    return each(parts, paths)


def _footer(spark: SparkSession, path: str, read: Callable[[object], T]) -> T:
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.parquet.hadoop
    source = hadoop.util.HadoopInputFile.fromPath(context._jvm.org.apache.hadoop.fs.Path(path), context._jsc.hadoopConfiguration())
    reader = hadoop.ParquetFileReader.open(source)
    try:
        return read(reader)
    finally:
        reader.close()


def stored_columns(spark: SparkSession, files: Sequence[str]) -> list[str]:
    """The stored columns and types of each Parquet file, as its footer spells them."""
    return each(lambda path: _footer(spark, path, lambda footer: footer.getFileMetaData().getSchema().toString()), files)


def row_counts(spark: SparkSession, folders: Sequence[str]) -> list[int]:
    """Rows of the Parquet files directly in each folder, from their footers."""
    parts = part_files(spark, folders)
    files = [file for found in parts for file in found or []]
    rows = dict(zip(files, each(lambda path: _footer(spark, path, lambda footer: footer.getRecordCount()), files), strict=True))
    return [sum(rows[file] for file in found or []) for found in parts]


def names_in(spark: SparkSession, folder: str) -> frozenset[str]:
    """Names of the files directly in a folder; none if it is absent."""
    files, place = _open(spark, folder)
    if not files.exists(place):
        return frozenset()
    return frozenset(s.getPath().getName() for s in files.listStatus(place))


def delete(spark: SparkSession, folders: Iterable[str]) -> None:
    for folder in folders:
        files, place = _open(spark, folder)
        files.delete(place, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    files, place = _open(spark, old)
    if not files.rename(place, _open(spark, new)[1]):
        raise OSError(f"cannot rename {old} to {new}")


def partition_values(spark: SparkSession, root: str, by: Sequence[str], skip: str | None = None) -> set[tuple[int, ...]]:
    """The values of the partition folders under ``root``, without those of the name ``skip``; an error for others that are no number."""
    files, place = _open(spark, root)
    found, todo = set(), [(place, ())] if files.exists(place) else []
    while todo:
        folder, values = todo.pop()
        if len(values) == len(by):
            found.add(values)
            continue
        for status in files.listStatus(folder):
            name, _, value = status.getPath().getName().partition("=")
            if name == by[len(values)] and value != skip:
                todo.append((status.getPath(), (*values, int(value))))
    return found


def make_folder(spark: SparkSession, folder: str) -> None:
    files, place = _open(spark, folder)
    files.mkdirs(place)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file; None if it is absent."""
    files, place = _open(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: it gets its name when it is complete."""
    files, place = _open(spark, path)
    part = place.suffix(".part")
    stream = files.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    files.delete(place, False)
    rename(spark, part.toString(), path)
