from datetime import date

import pytest

from semspark.operators.references import find_orphans, orphans_by_period

D = date
REFS = "id int, code string, day date, range string, reason string"
MASTER = "code string, a date, b date, key string"
PARENTS = [(" p1 ", D(2025, 1, 1), D(2025, 2, 1), "x"), ("P1", D(2025, 3, 1), None, "x"), ("P1", D(2025, 3, 1), None, "x"), ("P2", D(2025, 5, 1), D(2025, 5, 1), "x"), (None, D(2020, 1, 1), None, "x"), ("P3", None, None, "x"), ("P4", D(2025, 1, 1), D(2025, 6, 1), "x"), ("p4", D(2025, 2, 1), D(2025, 3, 1), "x")]
CASES = [
    (1, "p1\t", D(2025, 1, 1), None), (2, "P1", D(2025, 2, 1), "deleted"), (3, "P1", D(2024, 12, 31), "later"), (4, "P1", D(2199, 1, 1), None), (5, "P9", D(2025, 1, 1), "missing"),
    (6, "P9", None, "missing"), (7, "P1", None, None), (8, None, D(2025, 1, 1), None), (9, " \t", D(2025, 1, 1), None), (10, "P2", D(2025, 5, 1), "deleted"), (11, "P2", D(2025, 4, 1), "later"), (12, "P3", D(2025, 1, 1), "later"), (13, "P4", D(2025, 4, 1), None), (14, "P4", D(1926, 4, 1), "later"),
]


@pytest.mark.parametrize("kw", [{}, {"per_range": 1, "part_rows": 2}, {"per_range": 2}])
def test_reasons(spark, kw):
    refs = spark.createDataFrame([(i, c, d, "clash", "clash") for i, c, d, _ in CASES], REFS)
    got = find_orphans(refs, "code", "day", spark.createDataFrame(PARENTS, MASTER), "code", "a", "b", **kw)
    assert {r.id: r.reason for r in got.collect()} == {i: r for i, _, _, r in CASES if r}


def test_hot_key_is_cut_in_parts(spark):
    refs = spark.range(5000).selectExpr("CAST(id AS INT) AS id", "'P9' AS code", "DATE'2025-01-01' AS day")
    got = find_orphans(refs, "code", "day", spark.createDataFrame(PARENTS, MASTER), "code", "a", "b", part_rows=100)
    assert got.count() == 5000
    assert [tuple(r) for r in orphans_by_period(got, "day").collect()] == [(202501, "missing", 5000)]


def test_empty_tables(spark):
    refs, none = spark.createDataFrame([(1, "A", None, "", "")], REFS), spark.createDataFrame([], MASTER)
    assert [r.reason for r in find_orphans(refs, "code", "day", none, "code", "a", "b").collect()] == ["missing"]
    assert find_orphans(refs.limit(0), "code", "day", none, "code", "a", "b").count() == 0


def test_many_ranges(spark):
    parents = spark.range(3000).selectExpr("concat('K', id) AS code", "DATE'2025-01-01' + CAST(id % 50 AS INT) AS a", "IF(id % 3 = 0, DATE'2025-03-01', NULL) AS b", "'x' AS key")
    refs = spark.range(20_000).selectExpr("CAST(id AS INT) AS id", "IF(id % 4 = 0, 'k7', concat('k', id % 3500)) AS code", "DATE'2025-01-01' + CAST(id % 97 AS INT) AS day")

    def reason(i):
        k = 7 if i % 4 == 0 else i % 3500
        if k >= 3000:
            return "missing"
        d, a = i % 97, k % 50
        return None if a <= d and (k % 3 or d < 59) else "later" if d < a else "deleted"

    got = find_orphans(refs, "code", "day", parents, "code", "a", "b", per_range=64, part_rows=500)
    assert {r.id: r.reason for r in got.collect()} == {i: reason(i) for i in range(20_000) if reason(i)}
