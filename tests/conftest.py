import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from flightlens import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "flightlens-tests",
        spark__master="local[4]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="4",
        spark__sql__maxMetadataStringLength="2000",
        spark__sql__debug__maxToStringFields="200",
        # Some tests look up what their own queries have read: late in a whole run Spark would have begun to forget queries.
        spark__sql__ui__retainedExecutions="100000",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """rows("a int, b string", (1, "x"), ...) → DataFrame"""
    return lambda schema, *data: spark.createDataFrame([d if isinstance(d, tuple) else (d,) for d in data], schema)


def values(df, *order):
    """Rows as plain tuples, in the given order or sorted."""
    got = [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
    return got if order else sorted(got, key=repr)
