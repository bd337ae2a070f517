"""Registration of queries, and the SQL shared by several oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flightlens import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Raw tables by short name: ``t.flights`` is ``fx_flights``; test tables by their own."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.load(self.spark, self.sf_dir, f"fx_{name}")


def query(oracle: str | None = None, *parts: str):
    """Register a function of ``Tables`` under its own name. ``parts`` name the common
    table expressions the oracle needs; what those need in turn is added."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[build.__name__] = with_parts(oracle, parts)
        return build

    return register


# Common table expressions: name → (names it reads, SQL).
PARTS: dict[str, tuple[tuple[str, ...], str]] = {name: ((), sql) for name, sql in fixtures.SQL.items()}


def with_parts(sql: str, parts: tuple[str, ...]) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in PARTS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for part in parts:
        visit(part)
    ctes = ",\n".join(f"{name} AS ({PARTS[name][1].strip()})" for name in ordered)
    return f"WITH {ctes}\n{sql.strip()}" if ordered else sql.strip()


def part(name: str, needs: tuple[str, ...], sql: str) -> None:
    PARTS[name] = (needs, sql)


def case_of(column: str, names: dict, default: str = "NULL") -> str:
    """CASE expression of a code table."""

    def quoted(value) -> str:
        return str(value) if isinstance(value, int) else f"'{value}'"

    arms = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in names.items())
    return f"CASE {column} {arms} ELSE {default} END"
