"""Rolling totals over trailing days, days without activity included.

Rows are first summed to a row per entity and day. These are densified to the cross product of each entity with the
calendar of its span (first to last day with activity), and totals are window sums over a fixed number of preceding
rows. The calendar is unfolded in place, from each active day to the day before the next, which gives the rows of that
cross product in the partitions and the order that the windows need, without a shuffle of its own.

With ``each_day=False`` the days of a silence longer than the longest window, on which all figures are nought, stand in
one row that says through which day it lasts: a date a century off then costs a row, not 36 000. A fixed number of rows
is still that number of days, as each such silence follows a full window of empty days.

Defined results: rows without entity or date are left out; NaN, null and non-finite amounts add nothing and do not
count for the average; an average of nothing is null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def day_key(day: str) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def daily(df: DataFrame, entity: str, date: str, amounts: list[str]) -> DataFrame:
    """(entity, day, orders, <amount>_sum, <amount>_n): exact sums to four places."""
    cols = [F.expr(f"try_cast(`{a}` AS DECIMAL(24,4))").alias(a) for a in amounts]
    rows = df.select(F.col(entity).alias("entity"), F.col(date).cast("date").alias("day"), *cols).filter("entity IS NOT NULL AND day IS NOT NULL")
    return rows.groupBy("entity", "day").agg(F.count("*").alias("orders"), *[F.sum(a).alias(f"{a}_sum") for a in amounts], *[F.count(a).alias(f"{a}_n") for a in amounts])


def densify(days: DataFrame, longest: int | None = None) -> DataFrame:
    """``days`` with a row for every calendar day of each entity (column through: the last day for which the row stands).

    Of a silence only ``longest`` - 1 days get a row each, the rest of them one together; None: all of them.
    """
    # the rows before densifying are few and would be gathered in one task; the windows after it keep these partitions
    spread = days.repartition(int(days.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity")
    d = spread.withColumn("_next", F.lead("day").over(W.partitionBy("entity").orderBy("day")))
    stop = F.coalesce(F.date_sub("_next", 1), F.col("day"))
    edge = stop if longest is None else F.least(stop, F.date_add("day", longest - 1))
    at = F.transform(F.sequence("day", edge), lambda x: F.struct(x.alias("day"), x.alias("through")))
    if longest is not None:
        rest = F.when(stop > edge, F.array(F.struct(F.date_add(edge, 1).alias("day"), stop.alias("through")))).otherwise(F.array().cast("array<struct<day:date,through:date>>"))
        at = F.concat(at, rest)
    dense = d.withColumn("_at", F.explode(at))
    first = F.col("_at.day") == F.col("day")
    figures = [c for c in days.columns if c not in ("entity", "day")]
    return dense.select("entity", F.col("_at.day").alias("day"), F.col("_at.through").alias("through"), *[F.when(first, F.col(c)).alias(c) for c in figures])


def rolling_totals(df: DataFrame, entity: str, date: str, amounts: list[str], windows: tuple[int, ...] = (7, 30), each_day: bool = True) -> DataFrame:
    """Per entity and day: count, total and average over each trailing window (the day itself included)."""
    dense = densify(daily(df, entity, date, amounts), None if each_day else max(windows))
    out = {}
    for n in windows:
        w = W.partitionBy("entity").orderBy("day").rowsBetween(1 - n, 0)
        out[f"orders_{n}"] = F.coalesce(F.sum("orders").over(w), F.lit(0))
        for a in amounts:
            out[f"{a}_total_{n}"] = F.coalesce(F.sum(f"{a}_sum").over(w).cast("double"), F.lit(0.0))
            out[f"{a}_n_{n}"] = F.coalesce(F.sum(f"{a}_n").over(w), F.lit(0))
    rows = dense.withColumns(out)
    means = {f"{a}_avg_{n}": F.try_divide(F.col(f"{a}_total_{n}"), F.col(f"{a}_n_{n}").cast("double")) for a in amounts for n in windows}
    rows = rows.withColumns(means)
    named = [c for n in windows for c in (f"orders_{n}", *[f"{a}_{k}_{n}" for a in amounts for k in ("total", "avg")])]
    if each_day:
        return rows.select("entity", day_key("day").alias("day_key"), *named)
    return rows.select("entity", day_key("day").alias("day_key"), day_key("through").alias("through_key"), *named)
