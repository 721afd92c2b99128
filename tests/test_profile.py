import math
import random
from collections import Counter
from statistics import median

from pyspark.sql import functions as F

from semspark.operators import profile
from semspark.queries.problems import SPECS

SCHEMA = "feed_code string, load_id long, status string, country string, profit_amount double, value string, n int, bucket int"


def brute(data):
    out, by = set(), {}
    for f, load, *v in data:
        if load is not None:
            by.setdefault((f, load), []).append(v)
    for f, load in by:
        before = max((x for g, x in by if g == f and x < load), default=None)
        for c, name in enumerate(("status", "country", "profit_amount")):
            own = [None if isinstance(r[c], float) and math.isnan(r[c]) else r[c] for r in by[f, load]]
            have = [x for x in own if x is not None]
            bad = {"status": lambda x: x not in ("confirmed", "cancelled"), "country": lambda x: not (len(x) == 2 and x.isascii() and x.isupper() and x.isalpha()), "profit_amount": lambda x: x < -200000 or x > 2000000}[name]
            if sum(map(bad, have)) > 0.05 * len(have):
                out.add((load, name, "range" if c == 2 else "pattern"))
            if before is None:
                continue
            prev = [None if isinstance(r[c], float) and math.isnan(r[c]) else r[c] for r in by[f, before]]
            past = [x for x in prev if x is not None]
            if abs((len(own) - len(have)) / len(own) - (len(prev) - len(past)) / len(prev)) > 0.10:
                out.add((load, name, "null_rate"))
            if c < 2:
                d, p = len(set(have)), len(set(past))
                if d > 2 * p or 2 * d < p:
                    out.add((load, name, "distinct_count"))
                if have and past:
                    a, b = Counter(have), Counter(past)
                    if sum(abs(a[x] / len(have) - b[x] / len(past)) for x in a | b) / 2 > 0.30:
                        out.add((load, name, "distribution"))
            elif have and past and abs(median(have) - median(past)) > 0.5 * abs(median(past)):
                out.add((load, name, "distribution"))
    return out


def found(spark, data):
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in data], SCHEMA)
    states = profile.load_states(df, "feed_code", "load_id", SPECS)
    rows = [tuple(r) for r in profile.findings(df, "feed_code", "load_id", SPECS, states).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_findings_agree_with_brute_force(spark):
    rng = random.Random(4)
    data = []
    for feed in ("A", "B", None):
        for load in range(8):
            odd = rng.random()
            for _ in range(rng.randint(1, 60)):
                status = rng.choice(["confirmed", "cancelled"] if odd > 0.3 else ["confirmed", "CONFIRMED", None, "", "confirmed\n"])
                country = rng.choice(["DE", "CN"] if odd < 0.7 else ["DE", "DE\n", "de", None, "ÄÖ", "USA", "FR"])
                profit = rng.choice([float("nan"), None, 0.0, -0.0, rng.gauss(100, 40), rng.gauss(100, 40) * (9 if odd > 0.6 else 1), 3e6 if odd > 0.8 else 5.0, -3e5 if odd > 0.9 else 1.0])
                data.append((feed, load * 3 + {"A": 0, "B": 1, None: 2}[feed], status, country, profit))
    data += [("A", None, "x", "y", 1.0), ("C", 99, None, None, None), ("C", 100, None, None, float("nan"))]
    assert found(spark, data) == brute(data)


def test_exact_median_of_ties_and_even_counts(spark):
    data = [("A", 1, "confirmed", "DE", x) for x in (1.0, 1.0, 2.0, 1e9, -1e9, 0.5)] + [("A", 2, "confirmed", "DE", 7.0)] * 5
    df = spark.createDataFrame([(*r, "", 0, 0) for r in data], SCHEMA)
    spec = SPECS[2]
    got = profile.exact_medians(df, "feed_code", "load_id", spec, profile.load_states(df, "feed_code", "load_id", SPECS))
    assert {r.load: r.median for r in got.collect()} == {1: 1.0, 2: 7.0}


def test_ranges_distinct_counts_and_values(spark, rows):
    data = [("A", 1, s, "DE", x) for s, x in (("b", -5.0), ("a", 0.0), ("a", -0.0), (None, float("nan")), ("a", 7.25), ("c", 7.26))] + [(None, 2, None, "FR", None)]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in data], SCHEMA)
    states = profile.load_states(df, "feed_code", "load_id", SPECS)
    m = profile.full_metrics(df, "feed_code", "load_id", SPECS, states)
    got = {(r.load, r.column_name): (r.n, r.nulls, r.distinct_count, r.least, r.greatest, r.low, r.high, r.median) for r in m.collect()}
    assert got == {
        (1, "status"): (6, 1, 3, "a", "c", None, None, None), (1, "country"): (6, 0, 1, "DE", "DE", None, None, None), (1, "profit_amount"): (6, 1, 4, None, None, -5.0, 7.26, 0.0),
        (2, "status"): (1, 1, 0, None, None, None, None, None), (2, "country"): (1, 0, 1, "FR", "FR", None, None, None), (2, "profit_amount"): (1, 1, 0, None, None, None, None, None),
    }
    shares = profile.value_shares(profile.value_counts(df, "feed_code", "load_id", SPECS, states), m)
    assert rows(shares.filter("load = 1 AND column_name <> 'country'").select("value", "number", "n", "share")) == sorted([("a", None, 3, 0.6), ("b", None, 1, 0.2), ("c", None, 1, 0.2), (None, -5.0, 1, 0.2), (None, 0.0, 2, 0.4), (None, 7.25, 1, 0.2), (None, 7.26, 1, 0.2)], key=repr)


def test_control_limits_of_distinct_counts_and_medians(spark):
    data = [("A", load, ["confirmed", "cancelled", "x"][i % (3 if load == 9 else 1)], "DE", 9.0 if load == 9 else 1.0) for load in range(10) for i in range(20)]
    df = spark.createDataFrame([(*r, "", 0, 0) for r in data], SCHEMA)
    m = profile.full_metrics(df, "feed_code", "load_id", SPECS, profile.load_states(df, "feed_code", "load_id", SPECS))
    out = {(r.load, r.column_name, r.metric) for r in profile.control_limits(m).filter("out_of_control").collect()}
    assert out == {(9, "status", "distinct_count"), (9, "status", "bad_share"), (9, "profit_amount", "median")}


def test_states_of_parts_merge_to_those_of_all(spark, rows):
    data = [("A", i % 3, ["confirmed", None, "x"][i % 3], "DE", float(i % 7)) for i in range(60)]
    df = spark.createDataFrame([(*r, "", 0, 0) for r in data], SCHEMA)
    whole = profile.load_states(df, "feed_code", "load_id", SPECS)
    parts = [profile.load_states(df.filter(f"profit_amount {op} 3"), "feed_code", "load_id", SPECS) for op in ("<", ">=")]
    assert rows(profile.merge_states(*parts)) == rows(profile.merge_states(whole))


def test_saved_parts_merge_and_a_part_that_comes_again_replaces_itself(spark, rows, tmp_path):
    data = [("A", i % 3, ["confirmed", None, "x"][i % 3], "DE", float(i % 7)) for i in range(60)]
    df = spark.createDataFrame([(*r, "", i % 4, 0) for i, r in enumerate(data)], SCHEMA)
    save = lambda rows: profile.save_states(rows, "feed_code", "load_id", SPECS, F.when(F.col("n") > 0, F.col("n")), str(tmp_path / "s"))
    for n in (0, 1, 2, 3, 2):
        save(df.filter(F.col("n") == n))
    merged = profile.saved_states(df, "feed_code", "load_id", SPECS, str(tmp_path / "s"))
    assert rows(merged) == rows(profile.merge_states(profile.load_states(df, "feed_code", "load_id", SPECS)))


def test_control_limits_and_empty_table(spark):
    data = [("A", load, "confirmed" if load < 9 else None, "DE", 1.0) for load in range(10) for _ in range(20)]
    df = spark.createDataFrame([(*r, "", 0, 0) for r in data], SCHEMA)
    m = profile.load_metrics(profile.load_states(df, "feed_code", "load_id", SPECS))
    out = profile.control_limits(m).filter("out_of_control").collect()
    assert [(r.load, r.column_name, r.metric) for r in out] == [(9, "status", "null_rate")]
    assert found(spark, []) == set()
