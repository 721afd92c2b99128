import random
import re
from collections import Counter

import pytest

from semspark.llm.near_duplicates import NearDuplicates

SCHEMA = "key string, text string, size int, class_lo long, sig long, items string"


def brute(data, t=0.8):
    own = {}
    for k, s in set(data):
        c = Counter(re.findall(r"\w+", (s or "").lower()))
        if c and k is not None:
            own.setdefault(k, []).append(c)
    out = set()
    for a in own:
        for b in own:
            if a < b and any(sum((x & y).values()) >= t * sum((x | y).values()) - 1e-12 for x in own[a] for y in own[b]):
                out.add((a, b))
    return out


def pairs(spark, data, **kw):
    df = spark.createDataFrame([(*r, 1, 1, 1, "clash") for r in data], SCHEMA)
    rows = [tuple(r) for r in NearDuplicates(df, "key", "text", **kw).key_pairs().collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def mixed():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["and"] * 40
    data, texts = [], []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 5, 9, 10, 20, 40]))]
        for j in range(rng.randint(1, 6)):
            edit = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(edit) + 1)
                rng.choice([lambda: edit.insert(at, rng.choice(words)), lambda: edit.pop(at % len(edit)) if len(edit) > 1 else None, lambda: rng.shuffle(edit)])()
            texts.append((f"k{i}-{j}", rng.choice([" ", "\n", ", "]).join(edit).upper()))
    data += texts + texts[:20]
    data += [("n1", None), ("n2", ""), ("n3", "  ?! "), (None, "w1 w2"), ("z1", "Ähre_1 表名 x"), ("z2", "ähre_1 表名 X"), ("z2", "w1 w2 w3 w4"), ("z3", "w1 w2 w3 w4"), ("z4", "w1 w2 w3 w4 w5")]
    return data


@pytest.mark.parametrize("knobs", [{}, {"hot": 1}, {"per_share": 1.01, "hot": 3}, {"per_share": 4.0}])
def test_agrees_with_brute_force(spark, knobs):
    data = mixed()
    assert pairs(spark, data, **knobs) == brute(data)


@pytest.mark.parametrize("likeness", [1.0, 0.6, 0.5, 0.3])
def test_other_likeness(spark, likeness):
    data = mixed() + [(f"c{i:03}", f"common x{i}") for i in range(202)] + [("d", "common")]
    assert pairs(spark, data, likeness=likeness) == brute(data, likeness)


def test_likeness_out_of_range(spark):
    with pytest.raises(ValueError):
        pairs(spark, [("a", "x")], likeness=0.0)


def test_chains_reject_pairs_that_share_a_segment_and_lose_none(spark):
    data = mixed() + [(f"s{i}", " ".join(f"u{(i * 7 + j * j) % 97}" for j in range(36)) + " select from where and group by") for i in range(120)]
    n = NearDuplicates(spark.createDataFrame([(*r, 1, 1, 1, "clash") for r in data], SCHEMA), "key", "text")
    steps = dict(n.funnel())
    left = [steps["shared segment"], *[steps[f"chains of {k}"] for k in range(2, 17)]]
    assert left == sorted(left, reverse=True) and left[1] < left[0] and left[-1] < left[1]
    assert steps["distinct"] >= steps["alike"] > 0
    assert {tuple(r) for r in n.key_pairs().collect()} == brute(data)


def test_wide_classes_are_cut_and_whole(spark):
    data = [(f"k{i:02}", "select a from t") for i in range(40)] + [("x", "select a from t t")]
    n = NearDuplicates(spark.createDataFrame([(*r, 1, 1, 1, "clash") for r in data], SCHEMA), "key", "text")
    assert {tuple(r) for r in n.key_pairs(wide=3).collect()} == brute(data)
    assert {tuple(r) for r in n.members().collect()} == {(f"k{i:02}", "k00", 40, 40) for i in range(40)} | {("x", "x", 1, 40)}
    assert [tuple(r) for r in n.class_links().collect()] == [("k00", "x")]


def test_long_texts_and_saturated_words(spark):
    long = " ".join(f"t{i % 900}" for i in range(40_000))
    data = [("a", long), ("b", long + " extra words"), ("c", long[: len(long) // 2]), ("d", "and " * 20_000), ("e", "and " * 17_000), ("f", "and " * 15_000)]
    assert pairs(spark, data) == {("a", "b"), ("d", "e"), ("e", "f")}


def test_registered_query_agrees_with_brute_force(spark, small):
    import __spark_entry__ as entry

    data = [tuple(r) for n, k, t in (("nodes", "node_id", "query"), ("generation_attempts", "attempt_id", "sql_text")) for r in spark.read.parquet(f"{small}/{n}.parquet").select(k, t).collect()]
    assert {tuple(r) for r in entry.queries()["p4_found"](spark, small).collect()} == brute(data)


def test_empty_table(spark):
    assert pairs(spark, []) == set() and pairs(spark, [("a", None)]) == set()
