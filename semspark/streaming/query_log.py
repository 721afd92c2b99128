"""Streaming intake of a query log: counts per window, each statement once.

An extension: the reference has no stream. Late rows beyond the watermark are dropped by Spark and not counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sqltext

SCHEMA = "query string, timestamp timestamp, user string"


def read_log(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(path)


def windowed_usage(log: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, table, queries): how many distinct (user, statement, time) rows used each table in each window."""
    rows = log.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["query", "timestamp", "user"])
    used = rows.withColumn("table", F.explode(sqltext.tables(F.col("query"))))
    return used.groupBy(F.window("timestamp", window).alias("w"), "table").agg(F.count("*").alias("queries")).select(F.col("w.start").alias("start"), "table", "queries")
