"""References to records that do not exist: probing sorted parent arrays, range by range.

Parents are cut into key ranges by bounds from a sample of fixed size. Each range holds its keys as one sorted array and,
per key, its periods of validity as disjoint sorted intervals. References are cut by the same bounds and meet the arrays
of their range in a co-group, where each batch is probed by binary search, first for the key, then for the interval in
which its date falls. A range that many references hit is cut into as many parts as its measured count asks for.

Defined results: null and blank references are no references; a reference with an unknown date is only ever
``missing``; parents without a key are ignored, a parent without a start is never in force; rows sent twice count
once; empty tables give no row (without parents every reference is ``missing``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import loose_code
from ..session import materialise

FOREVER = 1 << 30  # a day after every date
RANGES = 4096  # at most; the keys of a range grow beyond that
PER_BOUND = 20  # sampled keys per range
REASONS = np.array([None, "missing", "later", "deleted"], dtype=object)


def parent_ranges(parents: DataFrame, key: str, start: str, end: str, per_range: int = 4096) -> tuple[DataFrame, list[str]]:
    """Rows (range, key, first, starts, ends) with one row per key, and the lower bounds of the ranges.

    first: the day of the earliest start. starts, ends: days of the key's merged intervals, sorted. The bounds come from
    the PER_BOUND * ranges keys of the least hashes, at most PER_BOUND * RANGES keys however many parents there are.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    rows = parents.select(loose_code(F.col(key)).alias("key"), day(start).alias("s"), F.coalesce(day(end), F.lit(FOREVER)).alias("e")).filter("key IS NOT NULL").distinct()
    spans = F.array_sort(F.filter(F.collect_list(F.struct("s", "e")), lambda x: x["s"].isNotNull() & (x["s"] < x["e"])))
    first = F.min("s")
    grouped = rows.groupBy("key").agg(spans.alias("spans"), first.alias("first"))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] >= x["s"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["s"].alias("s"), F.greatest(F.try_element_at(acc, F.lit(-1))["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(x))),
    )
    keys = materialise(grouped.withColumn("spans", merged).select("key", "first", F.col("spans.s").alias("starts"), F.col("spans.e").alias("ends")), "parents")
    cuts = min(RANGES, max(1, -(-keys.count() // per_range)))
    bounds: list[str] = []
    if cuts > 1:  # they decide only which range a key goes to
        sample = sorted(r["key"] for r in keys.select("key").orderBy(F.xxhash64("key"), "key").limit(PER_BOUND * cuts).collect())
        bounds = sorted({sample[i * len(sample) // cuts] for i in range(1, cuts)})
    return keys.withColumn("range", range_of(F.col("key"), bounds)), bounds


def range_of(key, bounds: list[str]):  # noqa: ANN001, ANN201
    """The range (from 0) into which a key falls, by binary search over the bounds."""
    if not bounds:
        return F.lit(0)

    @F.pandas_udf("int")
    def at(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, dtype=object), keys.fillna("").to_numpy(dtype=object), side="right").astype("int32"))

    return at(key)


class RangeArrays:
    """Sorted arrays of the parents of one range or of several."""

    def __init__(self, parents: pd.DataFrame):
        p = parents.sort_values("key")
        self.keys = p["key"].to_numpy(dtype=object)
        self.first = p["first"].fillna(FOREVER).to_numpy(dtype=np.int64)
        sizes = p["starts"].map(len).to_numpy(dtype=np.int64) if len(p) else np.zeros(0, np.int64)
        at = np.repeat(np.arange(len(p)), sizes)
        flat = lambda c: np.concatenate([np.asarray(x, dtype=np.int64) for x in p[c]]) if sizes.sum() else np.zeros(0, np.int64)
        self.starts, self.ends = at * (1 << 32) + flat("starts"), flat("ends")

    def probe(self, keys: np.ndarray, days: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Index into REASONS for each reference."""
        uniq, back = np.unique(keys, return_inverse=True)
        slot = np.searchsorted(self.keys, uniq)
        hit = np.zeros(len(uniq), bool)
        inside = slot < len(self.keys)
        hit[inside] = self.keys[slot[inside]] == uniq[inside]
        slot, hit = slot[back], hit[back]
        out = np.where(hit, 0, 1)
        ask = np.flatnonzero(hit & known)
        s, d = slot[ask], days[ask]
        i = np.searchsorted(self.starts, s * (1 << 32) + d, side="right") - 1
        ok = (i >= 0) & (len(self.starts) > 0)
        ok[ok] = (self.starts[i[ok]] >> 32 == s[ok]) & (self.ends[i[ok]] > d[ok])
        out[ask[~ok]] = np.where(d[~ok] < self.first[s[~ok]], 2, 3)
        return out


def find_orphans(refs: DataFrame, code: str, date: str, parents: DataFrame, parent_code: str, start: str, end: str, part_rows: int = 150_000, per_range: int = 4096) -> DataFrame:
    """The rows of ``refs`` whose code points to no parent in force on their date, with a column ``reason``.

    missing: no parent has the code. later: the date precedes every start. deleted: any other. Columns of ``refs``
    named reason, range, part, width, _key or _day are left out. A task holds at most the arrays of a range and about
    ``part_rows`` references.
    """
    refs = refs.select(*[c for c in refs.columns if c not in ("reason", "range", "part", "width", "_key", "_day")])
    keys, bounds = parent_ranges(parents, parent_code, start, end, per_range)
    tagged = refs.withColumns({"_key": loose_code(F.col(code)), "_day": F.unix_date(F.col(date).cast("date"))}).filter("_key IS NOT NULL")
    ranged = materialise(tagged.withColumn("range", range_of(F.col("_key"), bounds)), "references")
    out = refs.schema.names
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in refs.schema.fields), "reason string"])
    widths = F.broadcast(ranged.groupBy("range").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("width")))  # a row per range, at most RANGES
    part = F.pmod(F.monotonically_increasing_id(), F.col("width")).cast("int")  # of files already written, so the same again in a second try
    left = ranged.join(widths, "range").withColumn("part", part)
    right = keys.join(widths, "range").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).select("range", "part", "key", "first", "starts", "ends")

    def meet(batch: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        known = batch["_day"].notna().to_numpy()
        found = RangeArrays(own).probe(batch["_key"].to_numpy(dtype=object), batch["_day"].fillna(0).to_numpy(dtype=np.int64), known)
        return batch.loc[found > 0, out].assign(reason=REASONS[found[found > 0]])

    return left.groupBy("range", "part").cogroup(right.groupBy("range", "part")).applyInPandas(meet, schema)


def orphans_by_period(orphans: DataFrame, date: str, *by: str) -> DataFrame:
    """Counts of orphan references per group, month (YYYYMM; null where the date is unknown) and reason."""
    month = F.year(date) * 100 + F.month(date)
    return orphans.groupBy(*by, month.alias("month_key"), "reason").agg(F.count("*").alias("orphans"))
