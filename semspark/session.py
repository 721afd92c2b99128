"""Session settings and the shared folder in which long plans cut their lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own, with the package in --py-files or installed."""
    root = str(Path(__file__).resolve().parent.parent)  # so that workers find the package wherever the driver was started
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("semspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SEMSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a new one, but on this machine alone (local mode)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="semspark-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under one folder for all tables of this session."""
    own = spark.conf.get("semspark.tables", None)
    if not own:
        own = f"{shared_dir(spark).rstrip('/')}/semspark-{uuid.uuid4().hex}"
        spark.conf.set("semspark.tables", own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    Later jobs start from these files, so neither a lost executor nor a second use runs the plan above
    them again, and each use reads only its columns. Spark deletes what the write shuffled as soon as it is done
    (a setting of its own, since 4.1). ``drop_tables`` deletes the tables.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that this session has materialised; call it when the results made from them are written."""
    own = spark.conf.get("semspark.tables", None)
    if own:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        spark.conf.unset("semspark.tables")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
