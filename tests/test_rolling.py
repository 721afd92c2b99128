from datetime import date, timedelta

from semspark.operators.current import current_rows
from semspark.operators.rolling import rolling_totals

SCHEMA = "org string, day date, a double, b double, entity string, through string, orders int"
DAY = date(2025, 1, 1)


def key(d):
    return d.year * 10000 + d.month * 100 + d.day


def brute(data):
    out = {}
    for org in {r[0] for r in data if r[0] and r[1]}:
        own = [r for r in data if r[0] == org and r[1]]
        d, last = min(r[1] for r in own), max(r[1] for r in own)
        while d <= last:
            figures = []
            for n in (7, 30):
                win = [r for r in own if d - timedelta(n) < r[1] <= d]
                figures.append(len(win))
                for c in (2, 3):
                    have = [r[c] for r in win if r[c] is not None and r[c] == r[c] and abs(r[c]) < 1e15]
                    figures += [round(sum(have), 4), round(sum(have) / len(have), 4) if have else None]
            out[org, key(d)] = figures
            d += timedelta(1)
    return out


def expanded(spark, data):
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in data], SCHEMA)
    out = {}
    for r in rolling_totals(df, "org", "day", ["a", "b"], each_day=False).collect():
        d = date(r.day_key // 10000, r.day_key // 100 % 100, r.day_key % 100)
        assert r.day_key == r.through_key or r.orders_30 == 0
        while key(d) <= r.through_key:
            figures = [r.orders_7, round(r.a_total_7, 4), r.a_avg_7, round(r.b_total_7, 4), r.b_avg_7, r.orders_30, round(r.a_total_30, 4), r.a_avg_30, round(r.b_total_30, 4), r.b_avg_30]
            assert (r.entity, key(d)) not in out
            out[r.entity, key(d)] = [round(x, 4) if isinstance(x, float) else x for x in figures]
            d += timedelta(1)
    return out


def test_agrees_with_brute_force_over_gaps(spark):
    days = [0, 0, 1, 6, 7, 8, 36, 37, 38, 67, 68, 200, 231, 232]
    data = [("A", DAY + timedelta(n), 1.25 * n, float("nan") if n % 2 else None) for n in days] + [("B", DAY, None, 3.0), ("B", DAY + timedelta(500), -2.0, float("inf")), (None, DAY, 1.0, 1.0), ("C", None, 1.0, 1.0)]
    assert expanded(spark, data) == brute(data)
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in data], SCHEMA)
    got = {(r[0], r[1]): [round(x, 4) if isinstance(x, float) else x for x in r[2:]] for r in rolling_totals(df, "org", "day", ["a", "b"]).collect()}
    assert got == brute(data)


def test_absurd_dates_cost_few_rows(spark):
    data = [("A", date(1926, 1, 1), 1.0, 1.0), ("A", date(2206, 1, 1), 1.0, 1.0)]
    df = spark.createDataFrame([(*r, "", "", 1) for r in data], SCHEMA)
    assert rolling_totals(df, "org", "day", ["a"], each_day=False).count() == 32
    assert rolling_totals(df, "org", "day", ["a"]).count() == (date(2206, 1, 1) - date(1926, 1, 1)).days + 1


def test_each_day_of_a_silence_has_a_row(spark):
    data = [("A", DAY, 1.0, None), ("A", DAY + timedelta(400), 2.0, float("nan")), ("B", DAY, None, 3.0)]
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in data], SCHEMA)
    got = {(r[0], r[1]): list(r[2:]) for r in rolling_totals(df, "org", "day", ["a", "b"]).collect()}
    assert got == brute(data) and len(got) == 402


def test_empty_table(spark):
    assert rolling_totals(spark.createDataFrame([], SCHEMA), "org", "day", ["a", "b"]).count() == 0


def test_current_rows(spark, rows):
    data = [("1", 1, "a", 1.0), ("1", 2, "b", float("nan")), ("1", 2, "b", float("nan")), ("2", None, "c", 1.0), ("2", 1, "d", None), (None, 1, "e", 1.0), (None, 2, "e", 1.0), (None, 2, "e", 1.0), ("3", 5, "x", 1.0), ("3", 5, "y", 0.0)]
    df = spark.createDataFrame(data, "id string, at int, v string, x double")
    assert rows(current_rows(df, "id", ["at"], ["v", "x"])) == sorted([("1", "b", None), ("2", "d", None), (None, "e", 1.0), (None, "e", 1.0), ("3", "y", 0.0)], key=repr)
    assert current_rows(df.limit(0), "id", ["at"], ["v", "x"]).count() == 0
