"""Session settings and the scratch folder."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from flightlens import build_session, clear_scratch, pin_utc, scratch_dir
from flightlens.session import materialize

from conftest import values


def session(master, folder):
    context = SimpleNamespace(master=master, applicationId="app-1")
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=context)


def test_scratch_folder():
    assert scratch_dir(session("yarn", "hdfs:///shared/"), "x") == "hdfs:///shared/flightlens-app-1/x"
    local = scratch_dir(session("local[4]", None), "x")
    assert local.endswith("/flightlens-app-1/x") and scratch_dir(session("local", None), "x") == local
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(session("yarn", None), "x")


def test_stored_intermediate_tables_are_separate(rows):
    first, second = materialize(rows("x int", 1), "t"), materialize(rows("x int", 2), "t")
    assert values(first) == [(1,)] and values(second) == [(2,)]
    assert "FileScan parquet" in first._jdf.queryExecution().executedPlan().toString()


def test_intermediate_tables_can_be_cleared(spark, rows, tmp_path):
    settings = SimpleNamespace(get=lambda key, default: f"file:{tmp_path}")
    other = SimpleNamespace(conf=settings, sparkContext=spark.sparkContext)
    path = scratch_dir(other, "t")
    rows("x int", 1).write.parquet(path)
    assert Path(path.removeprefix("file:")).exists()
    clear_scratch(other)
    assert not list(tmp_path.iterdir())


def test_settings(spark):
    assert build_session().conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "dynamic"
    spark.conf.set("spark.sql.session.timeZone", "Europe/Warsaw")
    assert pin_utc(spark).conf.get("spark.sql.session.timeZone") == "UTC"
