import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semspark.llm.quantiles import ask, compress, load_summaries, merge, merge_tree, part_summaries, percentiles, summary

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def rank_error(values, value, rank):
    x = np.sort(values)
    lo, hi = np.searchsorted(x, value, "left") + 1, np.searchsorted(x, value, "right")
    return 0 if lo <= rank <= hi else min(abs(lo - rank), abs(hi - rank))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.floats(allow_nan=False, width=32), min_size=1, max_size=60), min_size=1, max_size=7), st.floats(0.01, 0.3))
def test_bounds_hold_after_any_merges(parts, eps):
    s = None
    for p in parts:
        own = compress(summary(np.array(p, float)), eps / 2 * len(p))
        s = own if s is None else compress(merge(s, own), eps / 2 * (s[0] + own[0]))
    every = np.concatenate([np.array(p, float) for p in parts])
    assert s[0] == len(every)
    for share in SHARES:
        value, rank, err = ask(s, share)
        assert rank_error(every, value, rank) <= err


SCHEMA = "g string, load long, x double, n long, value double, part string, measure string"


@pytest.mark.parametrize("eps", [0.005, 0.05])
def test_percentiles_of_loads_combine(spark, eps):
    rng = np.random.default_rng(1)
    data = [(None if i % 11 == 0 else "AB"[i % 2], i % 70, float(rng.choice([0.0, rng.lognormal(3, 2), -5.0, 1e9])), 1, 1.0, "c", "c") for i in range(6000)]
    data += [("A", 1, float("nan"), 1, 1.0, "c", "c"), ("A", None, None, 1, 1.0, "c", "c"), ("E", 1, None, 1, 1.0, "c", "c"), ("I", 1, math.inf, 1, 1.0, "c", "c")]
    states = load_summaries(spark.createDataFrame(data, SCHEMA).repartition(9), "g", "load", ["x"], eps)
    for keys, of in ((["group", "measure"], lambda r: r[0]), (["group", "part", "measure"], lambda r: (r[0], str(r[1])))):
        got = percentiles(states, keys, SHARES, eps).collect()
        by = {}
        for r in data:
            if r[2] is not None and r[2] == r[2]:
                by.setdefault(of(r), []).append(r[2])
        assert {(r.group if len(keys) == 2 else (r.group, r.part)) for r in got} == set(by)
        for r in got:
            own = by[r.group if len(keys) == 2 else (r.group, r.part)]
            assert r.n == len(own) and r.rank_error <= eps * r.n + 1
            assert rank_error(own, r.value, r.rank) <= r.rank_error


def test_empty_table(spark):
    states = load_summaries(spark.createDataFrame([], SCHEMA), "g", "load", ["x"])
    assert percentiles(states, ["group", "measure"], SHARES).count() == 0


def test_tasks_give_out_states_before_they_hold_too_many(spark):
    data = [("AB"[i % 2], i % 30, float(i * 7919 % 1000), 1, 1.0, "c", "c") for i in range(3000)]
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        states = part_summaries(df, "g", "load", ["x"], 0.05, buffer=50, most=10)
        assert states.count() > 60
        got = percentiles(merge_tree(states, ["group", "part", "measure"], 0.05, 0.25, 0.5), ["group"], SHARES, 0.05).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in got:
        every = np.array([d[2] for d in data if d[0] == r.group])
        assert r.n == len(every) and rank_error(every, r.value, r.rank) <= r.rank_error <= 0.05 * r.n + 1
