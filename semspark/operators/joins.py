"""Joins whose left side may hold one key in a large share of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, share: float = 0.001, least: int = 20_000) -> list:
    """Keys with more than ``share`` of the rows and more than ``least`` rows: at most 1/share of them."""
    counts = df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > least)
    rows = df.count()
    return [r[0] for r in counts.filter(F.col("n") > rows * share).filter(F.col(key).isNotNull()).select(key).collect()]


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner", parts: int = 32, share: float = 0.001, least: int = 20_000, hot: list | None = None) -> DataFrame:
    """Join with a right side that has each key once. Rows of hot keys go to ``parts`` tasks, each with a copy of the right row.

    hot: the hot keys of ``left`` where they are known already.
    """
    hot = hot_keys(left, key, share, least) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    salted = left.withColumn("_part", F.when(F.col(key).isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).otherwise(F.lit(0)))
    copies = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.withColumn("_part", F.explode(copies)), [key, "_part"], how).drop("_part")
