"""Columns and settings shared by the operators on texts.

Rows are told apart by ``did`` and ``sig``: the identifier (null becomes the largest long,
so that it never is the smallest) and a hash of the text. Rows equal in both are
copies and share every result.
"""

from __future__ import annotations

import functools
import pathlib
import tempfile
import zipfile

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = 2**63 - 1
BATCH_BYTES = "8388608"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@functools.cache
def ship_code(context: SparkContext) -> None:
    """Send this package to the executors: their Python may not have it installed."""
    root = pathlib.Path(__file__).parent.parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="flightlens-code-")) / "flightlens_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))


def prepare(spark: SparkSession, batch_bytes: str = BATCH_BYTES) -> None:
    """For operators with Python code: ship it, and keep the batches that go to Python at
    8 MB or what is given, whatever the length of a text."""
    ship_code(spark.sparkContext)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. ``lower`` does it much faster where there is nothing but ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def without(text: Column, chars: str) -> Column:
    """The text without some characters, each searched in one pass over the bytes."""
    for char in chars:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order, with empty strings among them."""
    for char in WHITE[1:]:
        text = F.replace(text, F.lit(char), F.lit(" "))
    return F.split(text, " ")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.filter(split_words(text), lambda w: w != "")


def did(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column), F.lit(NO_ID))


def sig(column: str = "text") -> Column:
    return F.xxhash64(F.col(column))


def quoted(names) -> list[Column]:
    """Columns of these very names, dots and all."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that ``df`` does not have."""
    taken, k, free = {c.lower() for c in df.columns}, 0, name
    while free.lower() in taken:
        k += 1
        free = f"{name}_{k}"
    return free


def keyed(df: DataFrame) -> tuple[DataFrame, str, str]:
    """``df`` with ``did`` and ``sig`` under names it does not have yet, and these names."""
    d, s = free_name(df, "did"), free_name(df, "sig")
    return df.withColumns({d: did(), s: sig()}), d, s
