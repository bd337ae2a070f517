"""Schema checks and schema clean-up; none of them starts a job."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, required: Sequence[str], table: str) -> DataFrame:
    """``df`` itself, or an error naming every column it lacks."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{table} lacks columns: {', '.join(missing)}")
    return df


def clean_names(df: DataFrame) -> DataFrame:
    """Column names Parquet accepts: blanks become ``_``; ``,;{}()=``, newline and tab go."""
    return df.toDF(*[re.sub(r"[,;{}()=\n\t]", "", name.replace(" ", "_")) for name in df.columns])


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Exactly the named columns, each in its declared type."""
    return df.select(*[F.col(name).cast(type_).alias(name) for name, type_ in types.items()])


def present(df: DataFrame, *names: str) -> DataFrame:
    """Rows in which every named column has a value. Written as separate conditions because,
    unlike ``dropna``, these reach the Parquet scan."""
    for name in names:
        df = df.filter(F.col(name).isNotNull())
    return df
