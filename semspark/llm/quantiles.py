"""Percentiles from mergeable rank-interval summaries with a certified rank error.

A summary holds tuples (value, rmin, rmax): the rank of that value among the n values seen lies between rmin and rmax.
Tasks summarise what they read per group and part (a load, a day), parts merge into groups over a tree of small
fan-in, and every stage drops tuples only while two neighbours stay within the rank uncertainty allowed so far. The
uncertainty allowed grows stage by stage to ``epsilon`` * n at the root. Each answer states its own error bound: the
larger distance between the rank asked for and the interval of the tuple given, so it holds whatever was merged.

Defined results: null and NaN values are left out; groups without values give no row; null groups form one group; ties
and infinities are values like any; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

FAN_IN = 32
STATE = "n long, level double, value array<double>, rmin array<long>, rmax array<long>"
Summary = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def summary(values: np.ndarray) -> Summary:
    v = np.sort(values)
    r = np.arange(1, len(v) + 1)
    return len(v), v, r, r


def merge(a: Summary, b: Summary) -> Summary:
    (n, v, lo, hi), (m, w, lo2, hi2) = a, b

    def within(x: np.ndarray, side: str, own_lo: np.ndarray, own_hi: np.ndarray, y: np.ndarray, l: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(y, x, side=side)
        under = np.where(i > 0, l[np.maximum(i - 1, 0)], 0) if len(y) else 0
        over = np.where(i < len(y), h[np.minimum(i, len(y) - 1)] - 1, size) if len(y) else 0
        return own_lo + under, own_hi + over

    alo, ahi = within(v, "right", lo, hi, w, lo2, hi2, m)
    blo, bhi = within(w, "left", lo2, hi2, v, lo, hi, n)
    values = np.concatenate((v, w))
    los, his = np.concatenate((alo, blo)), np.concatenate((ahi, bhi))
    order = np.lexsort((his, los, values))
    return n + m, values[order], los[order], his[order]


def compress(s: Summary, uncertainty: float) -> Summary:
    """Fewest tuples such that neighbours stay within twice ``uncertainty`` ranks; the ends stay."""
    n, v, lo, hi = s
    keep, i, last = [0], 0, len(v) - 1
    while i < last:
        j = int(np.searchsorted(hi, lo[i] + 2 * uncertainty, side="right")) - 1
        i = min(max(j, i + 1), last)
        keep.append(i)
    return n, v[keep], lo[keep], hi[keep]


def ask(s: Summary, share: float) -> tuple[float, int, int]:
    """(value, rank asked for, bound of the rank error)."""
    n, v, lo, hi = s
    r = min(max(int(np.ceil(share * n)), 1), n)
    err = np.maximum(r - lo, hi - r)
    i = int(np.argmin(err))
    return float(v[i]), r, int(max(err[i], 0))


def _row(s: Summary, level: float) -> tuple:
    return s[0], level, s[1].tolist(), s[2].tolist(), s[3].tolist()


def part_summaries(df: DataFrame, group: str, part: str, measures: list[str], epsilon: float, buffer: int = 500_000, most: int = 4096) -> DataFrame:
    """(group, part, measure, state) for each group and part that a task has read.

    A task holds at most ``buffer`` raw values and about ``most`` states; beyond that it gives out what it has, and a group may
    have several states from one task.
    """
    names = ["group", "part", "measure", "n", "level", "value", "rmin", "rmax"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw: dict[tuple, list[np.ndarray]] = {}
        done: dict[tuple, Summary] = {}
        held = 0

        def settle() -> None:
            for k, chunks in raw.items():
                s = summary(np.concatenate(chunks))
                s = merge(done[k], s) if k in done else s
                done[k] = compress(s, epsilon / 4 * s[0])
            raw.clear()

        for batch in batches:
            for (g, p), rows in batch.groupby(["group", "part"], dropna=False, sort=False):
                g, p = None if pd.isna(g) else g, None if pd.isna(p) else p
                for m in measures:
                    x = rows[m].to_numpy(dtype=float)
                    x = x[~np.isnan(x)]
                    if len(x):
                        raw.setdefault((g, p, m), []).append(x)
                        held += len(x)
            if held > buffer:
                settle()
                held = 0
                if len(done) > most:
                    yield pd.DataFrame([k + _row(s, 0.0) for k, s in done.items()], columns=names)
                    done.clear()
        settle()
        if done:
            yield pd.DataFrame([k + _row(s, 0.0) for k, s in done.items()], columns=names)

    rows = df.select(F.col(group).cast("string").alias("group"), F.col(part).cast("string").alias("part"), *[F.col(m).cast("double").alias(m) for m in measures])
    return rows.mapInPandas(run, f"`group` string, part string, measure string, {STATE}")


def _merged(states: DataFrame, keys: list[str], epsilon: float, share: float) -> DataFrame:
    """One state per ``keys``, compressed to ``share`` of the allowed uncertainty."""
    schema = ", ".join([*(f"`{k}` {t}" for k, t in states.select(*keys).dtypes), STATE])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [(int(n), np.asarray(v, float), np.asarray(a, np.int64), np.asarray(b, np.int64)) for n, v, a, b in zip(rows["n"], rows["value"], rows["rmin"], rows["rmax"], strict=True)]
        while len(parts) > 1:
            parts = [merge(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        s = compress(parts[0], epsilon * share * parts[0][0])
        return pd.DataFrame([(*[None if pd.isna(k) else k for k in key], *_row(s, share))], columns=[*keys, "n", "level", "value", "rmin", "rmax"])

    return states.groupBy(*keys).applyInPandas(run, schema)


def merge_tree(states: DataFrame, keys: list[str], epsilon: float, low: float, high: float) -> DataFrame:
    """States of equal ``keys`` merged over a tree: no task merges many more than FAN_IN states."""
    most = states.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    widths = []
    while most > FAN_IN:
        most = -(-most // FAN_IN)
        widths.append(most)
    stages = len(widths) + 1
    other = [c for c in states.columns if c not in keys and c not in ("n", "level", "value", "rmin", "rmax")]
    states = states.withColumn("_at", F.xxhash64(*other, "n", "value") if other else F.xxhash64("n", "value"))
    for i, width in enumerate(widths, 1):
        spread = states.withColumn("_at", F.pmod("_at", F.lit(width)).cast("long"))
        states = _merged(spread, [*keys, "_at"], epsilon, low + (high - low) * i / stages)
    return _merged(states, keys, epsilon, high)


def load_summaries(df: DataFrame, group: str, part: str, measures: list[str], epsilon: float = 0.005) -> DataFrame:
    """A state per group, part and measure, written to the shared folder."""
    return materialise(merge_tree(materialise(part_summaries(df, group, part, measures, epsilon), "part_states"), ["group", "part", "measure"], epsilon, 0.25, 0.5), "load_states")


def percentiles(states: DataFrame, keys: list[str], shares: list[float], epsilon: float = 0.005) -> DataFrame:
    """(keys, percentile, value, n, rank, rank_error) of states merged by ``keys``; rank_error is at most epsilon * n + 1."""
    schema = ", ".join([*(f"`{k}` {t}" for k, t in states.select(*keys).dtypes), "percentile double, value double, n long, rank long, rank_error long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                s = (int(row.n), np.asarray(row.value, float), np.asarray(row.rmin), np.asarray(row.rmax))
                for p in shares:
                    value, rank, err = ask(s, p)
                    out.append((*[getattr(row, k) for k in keys], p, value, s[0], rank, err))
            yield pd.DataFrame(out, columns=[*keys, "percentile", "value", "n", "rank", "rank_error"])

    return merge_tree(states, keys, epsilon, 0.5, 1.0).mapInPandas(run, schema)
