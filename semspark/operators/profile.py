"""Column profiles of loads: one aggregate scan, mergeable states, drift and control limits.

Checks are declared as ``ColumnSpec``. All of them compile into a single scan that groups by load and by the value of
one column at a time (grouping sets): the state of a load is a table (group, load, column, value, n, bad), and states
of two parts of a load, or of loads that came on two days, merge by adding n and bad. ``save_states`` keeps the states of
each part of the rows (a day or month of arrival) in a folder of its own, so that a part that comes or comes again is the
only one read; ``saved_states`` merges them. A state holds every text of a column, as exact shares need. Numeric columns are held in
buckets of nearly equal values, which narrow the exact median down to one bucket; only that bucket is read again. The
ends of a bucket merge as least and greatest; exact values and distinct counts of numbers need a count of their own.

Defined results: NaN counts as null; rows without a load are of no load; rows without a feed form one feed; a load
without a preceding one gives no drift finding; shares of nothing (no non-null value) differ from nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnSpec:
    """A column and its constraint: ``pattern`` (texts) or ``low``/``high`` (numbers)."""

    name: str
    pattern: str | None = None
    low: float | None = None
    high: float | None = None

    @property
    def numeric(self) -> bool:
        return self.pattern is None

    def bad(self, value: Column) -> Column:
        return ~value.rlike(self.pattern) if self.pattern is not None else (value < self.low) | (value > self.high)


@dataclass(frozen=True)
class Limits:
    null_rate: float = 0.10
    distinct_ratio: float = 2.0
    bad_share: float = 0.05
    distribution: float = 0.30
    median: float = 0.5


def _number(value: Column) -> Column:
    v = value.cast("double")
    return F.when(~F.isnan(v), v + F.lit(0.0))


def bucket(value: Column) -> Column:
    """A whole number that grows with the value; values in one bucket differ by less than 1/64 of their size."""
    size = F.log2(F.abs(value) + 1.0) * 90
    return F.when(value < 0, -F.floor(size) - 1).otherwise(F.floor(size)).cast("bigint")


def load_states(df: DataFrame, feed: str, load: str, specs: list[ColumnSpec], part: Column | None = None) -> DataFrame:
    """State table (feed, load, column_name, value, bucket, n, bad, low, high) of all columns in one scan.

    With ``part``, a state for each part of a load, in a last column part.

    low and high are the least and greatest number of a bucket; null for texts, whose states hold the value itself.
    """
    texts, numbers = [s for s in specs if not s.numeric], [s for s in specs if s.numeric]
    rows = df.filter(F.col(load).isNotNull()).select(
        F.col(feed).alias("feed"), F.col(load).alias("load"), (F.lit("") if part is None else F.coalesce(part.cast("string"), F.lit(""))).alias("part"),
        *[F.col(s.name).cast("string").alias(f"t_{s.name}") for s in texts],
        *[_number(F.col(s.name)).alias(f"x_{s.name}") for s in numbers],
    )
    for s in numbers:
        rows = rows.withColumn(f"b_{s.name}", bucket(F.col(f"x_{s.name}")))
    keys = [f"t_{s.name}" for s in texts] + [f"b_{s.name}" for s in numbers]
    order = texts + numbers
    # the measured number of a row must not be among the grouping columns, so its constraint is tested before
    rows = rows.withColumns({f"bad_{s.name}": s.bad(F.col(f"x_{s.name}")).cast("bigint") for s in numbers})
    sets = [[F.col("feed"), F.col("load"), F.col("part"), F.col(k)] for k in keys]
    total = rows.groupingSets(sets, F.col("feed"), F.col("load"), F.col("part"), *[F.col(k) for k in keys])
    ends = [f(f"x_{s.name}").alias(f"{k}_{s.name}") for s in numbers for k, f in (("low", F.min), ("high", F.max))]
    agg = total.agg(F.count("*").alias("n"), *[F.sum(f"bad_{s.name}").alias(f"sum_{s.name}") for s in numbers], *ends, *[F.grouping(k).alias(f"g_{k}") for k in keys])
    name = F.coalesce(*[F.when(F.col(f"g_{k}") == 0, F.lit(s.name)) for k, s in zip(keys, order, strict=True)])
    value = F.coalesce(*[F.when(F.col(f"g_t_{s.name}") == 0, F.col(f"t_{s.name}")) for s in texts], F.lit(None).cast("string"))
    where = F.coalesce(*[F.when(F.col(f"g_b_{s.name}") == 0, F.col(f"b_{s.name}")) for s in numbers], F.lit(None).cast("bigint"))
    bad = F.coalesce(
        *[F.when((F.col(f"g_t_{s.name}") == 0) & F.col(f"t_{s.name}").isNotNull(), F.when(s.bad(F.col(f"t_{s.name}")), F.col("n")).otherwise(F.lit(0))) for s in texts],
        *[F.when(F.col(f"g_b_{s.name}") == 0, F.col(f"sum_{s.name}")) for s in numbers],
        F.lit(0),
    )
    end = lambda k: F.coalesce(*[F.when(F.col(f"g_b_{s.name}") == 0, F.col(f"{k}_{s.name}")) for s in numbers], F.lit(None).cast("double")).alias(k)
    return agg.select("feed", "load", name.alias("column_name"), value.alias("value"), where.alias("bucket"), "n", bad.cast("bigint").alias("bad"), end("low"), end("high"), *([] if part is None else ["part"]))


def merge_states(*states: DataFrame) -> DataFrame:
    """States of parts of the same loads, or of other loads, as one."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("feed", "load", "column_name", "value", "bucket").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("low").alias("low"), F.max("high").alias("high"))


def save_states(df: DataFrame, feed: str, load: str, specs: list[ColumnSpec], part: Column, path: str) -> None:
    """Write the states of the parts that ``df`` holds to ``path``; parts that are there already are replaced, others stay."""
    states = load_states(df, feed, load, specs, part).withColumn("part", F.when(F.col("part") != "", F.col("part")))
    states.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("part").parquet(path)


def saved_states(df: DataFrame, feed: str, load: str, specs: list[ColumnSpec], path: str) -> DataFrame:
    """The merged states of all parts at ``path``; ``df`` gives the types of feed and load only."""
    schema = load_states(df.limit(0), feed, load, specs).schema
    return merge_states(df.sparkSession.read.schema(schema).parquet(path))


def load_metrics(states: DataFrame) -> DataFrame:
    """Per load and column: n, nulls, filled, distinct_values (texts only), bad."""
    null = F.col("value").isNull() & F.col("bucket").isNull()
    return states.groupBy("feed", "load", "column_name").agg(
        F.sum("n").alias("n"), F.sum(F.when(null, F.col("n")).otherwise(0)).alias("nulls"), F.sum(F.when(null, 0).otherwise(F.col("n"))).alias("filled"),
        F.count("value").alias("distinct_values"), F.sum("bad").alias("bad"),
    )


def exact_medians(df: DataFrame, feed: str, load: str, spec: ColumnSpec, states: DataFrame) -> DataFrame:
    """(feed, load, median): mean of the two middle values, without sorting a load.

    Running counts over the buckets of a load say which bucket holds either middle rank; the values of these buckets
    alone are counted and ranked.
    """
    by = W.partitionBy("feed", "load")
    s = states.filter((F.col("column_name") == spec.name) & F.col("bucket").isNotNull())
    s = s.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("all", F.sum("n").over(by))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor((F.col("all") + 2) / 2)
    held = s.withColumn("before", F.col("upto") - F.col("n")).withColumn("lo", low).withColumn("hi", high)
    held = held.filter(((F.col("lo") > F.col("before")) & (F.col("lo") <= F.col("upto"))) | ((F.col("hi") > F.col("before")) & (F.col("hi") <= F.col("upto"))))
    held = held.select("feed", "load", "bucket", "before", "lo", "hi")
    rows = df.filter(F.col(load).isNotNull()).select(F.col(feed).alias("feed"), F.col(load).alias("load"), _number(F.col(spec.name)).alias("x")).filter("x IS NOT NULL")
    rows = rows.withColumn("bucket", bucket(F.col("x")))
    same = [rows["feed"].eqNullSafe(held["feed"]), rows["load"] == held["load"], rows["bucket"] == held["bucket"]]
    inside = rows.join(held, same).select(held["feed"], held["load"], held["bucket"], "before", "lo", "hi", "x")
    counts = inside.groupBy("feed", "load", "bucket", "before", "lo", "hi", "x").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("feed", "load", "bucket").orderBy("x")) + F.col("before")
    ranked = counts.withColumn("upto", upto)
    hit = lambda r: F.max(F.when((F.col(r) <= F.col("upto")) & (F.col(r) > F.col("upto") - F.col("n")), F.col("x")))
    return ranked.groupBy("feed", "load").agg(((hit("lo") + hit("hi")) / 2).alias("median"))


def value_counts(df: DataFrame, feed: str, load: str, specs: list[ColumnSpec], states: DataFrame) -> DataFrame:
    """(feed, load, column_name, value, number, n): how often each text (value) or number stands in a load, nulls left out."""
    out = states.filter("value IS NOT NULL").groupBy("feed", "load", "column_name", "value").agg(F.sum("n").alias("n"))
    out = out.select("feed", "load", "column_name", "value", F.lit(None).cast("double").alias("number"), "n")
    for s in specs:
        if s.numeric:
            rows = df.filter(F.col(load).isNotNull()).select(F.col(feed).alias("feed"), F.col(load).alias("load"), _number(F.col(s.name)).alias("number")).filter("number IS NOT NULL")
            counts = rows.groupBy("feed", "load", "number").agg(F.count("*").alias("n"))
            out = out.unionByName(counts.select("feed", "load", F.lit(s.name).alias("column_name"), F.lit(None).cast("string").alias("value"), "number", "n"))
    return out


def value_shares(counts: DataFrame, metrics: DataFrame) -> DataFrame:
    """``counts`` with each value's share of the non-null rows of its load and column."""
    m = metrics.select("feed", "load", "column_name", "filled")
    on = [counts["feed"].eqNullSafe(m["feed"]), counts["load"] == m["load"], counts["column_name"] == m["column_name"]]
    return counts.join(m, on).select(counts["feed"], counts["load"], counts["column_name"], "value", "number", "n", (F.col("n") / F.col("filled")).alias("share"))


def full_metrics(df: DataFrame, feed: str, load: str, specs: list[ColumnSpec], states: DataFrame) -> DataFrame:
    """load_metrics with distinct_count of every column, ranges (least, greatest of texts; low, high of numbers) and median of numbers."""
    keys = ["feed", "load", "column_name"]
    ends = states.groupBy(*keys).agg(F.min("value").alias("least"), F.max("value").alias("greatest"), F.min("low").alias("low"), F.max("high").alias("high"))
    parts = [ends, value_counts(df, feed, load, specs, states).groupBy(*keys).agg(F.count("*").alias("distinct_count"))]
    medians = [exact_medians(df, feed, load, s, states).withColumn("column_name", F.lit(s.name)) for s in specs if s.numeric]
    parts.append(reduce(DataFrame.unionByName, medians) if medians else states.select(*keys, F.lit(None).cast("double").alias("median")).limit(0))
    out = load_metrics(states)
    for p in parts:
        on = [out["feed"].eqNullSafe(p["feed"]), out["load"] == p["load"], out["column_name"] == p["column_name"]]
        out = out.join(p, on, "left").select(*[out[c] for c in out.columns], *[p[c] for c in p.columns if c not in keys])
    return out.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))


def before(loads: DataFrame, *values: str) -> DataFrame:
    """``loads`` (a row per feed, load and column) with each value of the feed's preceding load as prev_<value>."""
    w = W.partitionBy("feed", "column_name").orderBy("load")
    return loads.withColumns({f"prev_{v}": F.lag(v).over(w) for v in values} | {"has_before": F.lag(F.lit(True)).over(w)})


def share_shift(states: DataFrame, metrics: DataFrame) -> DataFrame:
    """(feed, load, column_name, shift): half the summed change of the values' shares against the preceding load."""
    w = W.partitionBy("feed", "column_name").orderBy("load")
    m = metrics.withColumn("next", F.lead("load").over(w)).withColumn("prev_filled", F.lag("filled").over(w))
    m = m.select("feed", "load", "column_name", "filled", "next", "prev_filled")
    v = states.filter(F.col("value").isNotNull()).groupBy("feed", "load", "column_name", "value").agg(F.sum("n").alias("n"))
    on = [v["feed"].eqNullSafe(m["feed"]), v["load"] == m["load"], v["column_name"] == m["column_name"]]
    share = v.join(m, on).select(v["feed"], v["load"], v["column_name"], "value", (F.col("n") / F.col("filled")).alias("share"), "next", "prev_filled")
    here = share.filter(F.col("prev_filled") > 0).select("feed", "load", "column_name", "value", "share")
    there = share.filter(F.col("next").isNotNull()).select("feed", F.col("next").alias("load"), "column_name", "value", (-F.col("share")).alias("share"))
    change = here.unionByName(there).groupBy("feed", "load", "column_name", "value").agg(F.sum("share").alias("share"))
    shift = change.groupBy("feed", "load", "column_name").agg((F.sum(F.abs("share")) / 2).alias("shift"))
    both = m.filter((F.col("filled") > 0) & (F.col("prev_filled") > 0)).select("feed", "load", "column_name")
    on = [shift["feed"].eqNullSafe(both["feed"]), shift["load"] == both["load"], shift["column_name"] == both["column_name"]]
    return shift.join(both, on, "left_semi")


def findings(df: DataFrame, feed: str, load: str, specs: list[ColumnSpec], states: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(load, column_name, finding) for each load and column that breaks its constraint or differs from the load before."""
    texts, numbers = [s.name for s in specs if not s.numeric], [s.name for s in specs if s.numeric]
    m = before(load_metrics(states), "n", "nulls", "distinct_values")
    text = F.col("column_name").isin(texts)
    drift = F.abs(F.col("nulls") / F.col("n") - F.col("prev_nulls") / F.col("prev_n")) > limits.null_rate
    d, p, r = F.col("distinct_values"), F.col("prev_distinct_values"), limits.distinct_ratio
    tests = F.array(
        F.when(drift, F.lit("null_rate")),
        F.when(text & F.col("has_before") & ((d > p * r) | (d * r < p)), F.lit("distinct_count")),
        F.when(F.col("bad") > F.col("filled") * limits.bad_share, F.when(text, F.lit("pattern")).otherwise(F.lit("range"))),
    )
    out = m.select("load", "column_name", F.explode(F.array_compact(tests)).alias("finding"))
    shift = share_shift(states.filter(text), load_metrics(states).filter(text))
    out = out.unionByName(shift.filter(F.col("shift") > limits.distribution).select("load", "column_name", F.lit("distribution").alias("finding")))
    for s in specs:
        if s.numeric:
            loads = load_metrics(states).filter(F.col("column_name") == s.name).select("feed", "load", "column_name")
            mid = exact_medians(df, feed, load, s, states)
            all_loads = loads.join(mid, [loads["feed"].eqNullSafe(mid["feed"]), loads["load"] == mid["load"]], "left").select(loads["feed"], loads["load"], "column_name", "median")
            far = F.abs(F.col("median") - F.col("prev_median")) > F.abs(F.col("prev_median")) * limits.median
            out = out.unionByName(before(all_loads, "median").filter(far).select("load", "column_name", F.lit("distribution").alias("finding")))
    return out.distinct()


def control_limits(metrics: DataFrame, history: int = 8, sigmas: float = 3.0, least: int = 4) -> DataFrame:
    """Metrics of each load with the control limits of the feed's ``history`` loads before it, and whether they hold.

    Loads with fewer than ``least`` before them have no limits (null). Of full_metrics, distinct counts and medians are
    tested too; a load without numbers has no median.
    """
    more = [x for c in ("distinct_count", "median") if c in metrics.columns for x in (F.lit(c), F.col(c).cast("double"))]
    rates = metrics.select("feed", "load", "column_name", F.explode(F.create_map(
        F.lit("null_rate"), F.try_divide(F.col("nulls"), F.col("n")), F.lit("bad_share"), F.try_divide(F.col("bad"), F.col("filled")),
        F.lit("row_count"), F.col("n").cast("double"), *more)).alias("metric", "figure")).filter("metric <> 'median' OR figure IS NOT NULL")
    w = W.partitionBy("feed", "column_name", "metric").orderBy("load").rowsBetween(-history, -1)
    mean, sd, n = F.avg("figure").over(w), F.stddev_pop("figure").over(w), F.count("figure").over(w)
    out = rates.withColumns({"mean": F.when(n >= least, mean), "sd": F.when(n >= least, sd)})
    return out.withColumn("out_of_control", F.abs(F.col("figure") - F.col("mean")) > sigmas * F.col("sd") + 1e-9)
