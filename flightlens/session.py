"""Session settings, and where intermediate tables go."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "flightlens", *, hive: bool = False, **conf: str) -> SparkSession:
    """A session with the settings the tables rely on.

    ANSI mode and adaptive execution are Spark 4 defaults and stay on. The zone is
    pinned because storm times are wall-clock times: a zone with daylight saving
    would drop or repeat hours.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # A task that writes few months keeps their files open instead of sorting its rows.
        .config("spark.sql.maxConcurrentOutputFileWriters", "4")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    if hive:
        builder = builder.enableHiveSupport()
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Pin the zone of a session that was built elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="flightlens-")


def _scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/flightlens-{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder for an intermediate table, under the session's checkpoint folder.

    Only a local session without the setting falls back to a temporary folder; on a
    cluster that would be a disk the other executors cannot see.
    """
    return f"{_scratch_root(spark)}/{name}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the session's intermediate tables. Results that were not stored elsewhere still
    read them, so this is for the end of a session or of a load."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    root.getFileSystem(context._jsc.hadoopConfiguration()).delete(root, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, under a path of its own, and read it back.

    ``clear_scratch`` removes it. Used where several results share one aggregate: the lineage is cut, and a lost
    executor costs a re-read of the written files rather than a second scan.
    """
    path = scratch_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
