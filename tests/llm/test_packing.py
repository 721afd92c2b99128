import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semspark.llm.packing import best_fit_decreasing, pack


def plain_best_fit(sizes, capacity):
    free, out = [], []
    for s in sizes:
        fit = [(f, i) for i, f in enumerate(free) if f >= s]
        if fit:
            i = min(fit)[1]
        else:
            free.append(capacity)
            i = len(free) - 1
        free[i] -= s
        out.append(i)
    return free


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.sampled_from([40, 41, 63, 64]))
def test_tree_finds_the_tightest_container(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    bins = best_fit_decreasing(sizes, capacity)
    used = Counter()
    for s, b in zip(sizes, bins):
        used[b] += s
    assert sorted(capacity - u for u in used.values()) == sorted(plain_best_fit(sizes, capacity))


@pytest.mark.parametrize("shard", [20_000, 50])
def test_nothing_is_lost_or_cut(spark, shard):
    rng = random.Random(1)
    data = [(i, rng.choice([0, 1, 3, 17, 100, 512, 700, 1024, 1025, 2048, 2049, 4096, 10_000])) for i in range(700)] + [(9001, None)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in data], "doc_id long, size int, container string, piece_no int")
    got = pack(df, "doc_id", "size", 2048, shard_items=shard).collect()
    total, bins, pieces = Counter(), Counter(), Counter()
    for r in got:
        total[r.key] += r.n_tokens
        pieces[r.key] += 1
        assert (r.container is None) == (r.n_tokens == 0)
        if r.container:
            bins[r.container] += r.n_tokens
    assert total == Counter({k: v or 0 for k, v in data}) and set(total) == {k for k, _ in data}
    assert max(bins.values()) <= 2048
    assert all(pieces[k] == max(1, -(-(v or 0) // 2048)) for k, v in data)
    rests = sorted((v % 2048 for _, v in data if v and v % 2048), reverse=True)
    full = sum(v // 2048 for _, v in data if v)
    assert len(bins) <= 1.03 * (full + len(plain_best_fit(rests, 2048))) + 1


def test_equal_sizes_and_empty_table(spark):
    df = spark.range(100).selectExpr("id", "1024 AS size")
    assert pack(df, "id", "size", 2048).select("container").distinct().count() == 50
    assert pack(df.limit(0), "id", "size", 2048).count() == 0
