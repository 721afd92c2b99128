"""The current row of each key among rows that arrive again and again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str, newest: list[str], columns: list[str]) -> DataFrame:
    """Of each ``key`` the row with the greatest ``newest``, with ``key`` and ``columns``.

    One aggregation that combines before the shuffle, so a key sent very often does not gather in one task.
    Null stamps are oldest; of rows with equal stamps the one with the greatest columns counts; rows without a key
    are each their own current row, rows sent twice once. NaN counts as null.
    """
    kinds = dict(df.dtypes)
    clean = df.select(*[(F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in dict.fromkeys([key, *newest, *columns])])
    packed = clean.select(key, F.struct(*newest, *[c for c in columns if c not in newest]).alias("row"))
    keyed = packed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("row").alias("row"))
    loose = packed.filter(F.col(key).isNull()).distinct()
    return keyed.unionByName(loose).select(key, *[F.col(f"row.{c}").alias(c) for c in columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
