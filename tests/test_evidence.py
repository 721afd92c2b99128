from itertools import combinations

from semspark.operators.evidence import align_classes

SCHEMA = "record_id long, label string, normalized string, implementation string, field string, dataset string, tables array<string>"


def test_candidates_meet_on_label_field_implementation_or_dataset(spark):
    data = [
        (1, "profit", "sum(a)", "a", "d1", ["t1"]), (2, "profit", "max(b)", "b", "d2", ["t2"]), (3, "amount", "sum(a)", "a", None, ["t1"]), (4, "stock", "a", "a", "d3", None),
        (5, "orders", "sum(x)", "x", "d9", ["t9"]), (6, "order", "sum(y)", "y", "d9", ["t9"]), (7, "ordersz", "sum(z)", "z", "d8", ["t9"]), (8, "zz", "q", "q", "d7", ["t7"]), (8, "zz", "r", "r", "d7", ["t7"]),
        (9, "c1", "a", "a", "d1", ["t1"]), (5, "orders", "sum(x)", "x", "d9", ["t9"]),
    ]
    df = spark.createDataFrame([(r, n, n, *rest) for r, n, *rest in data], SCHEMA)
    got = {frozenset([(r.left_label, r.left_implementation), (r.right_label, r.right_implementation)]): r.score for r in align_classes(df).collect()}
    pair = lambda a, b: frozenset([a, b])
    reports = 8
    one, nine = 1 - 2 / reports, 1 - 3 / reports  # weights of tables in two and in three of the reports
    assert got == {
        pair(("profit", "sum(a)"), ("profit", "max(b)")): 5.0, pair(("profit", "sum(a)"), ("amount", "sum(a)")): 9.0 + one,
        pair(("profit", "sum(a)"), ("stock", "a")): 4.0, pair(("amount", "sum(a)"), ("stock", "a")): 4.0, pair(("orders", "sum(x)"), ("order", "sum(y)")): 3.5 + nine,
    }
    assert len({p for p in combinations(got, 2) if p[0] == p[1]}) == 0
    assert align_classes(df.limit(0)).count() == 0
