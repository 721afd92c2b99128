import pytest

from semspark.operators import sqlfacts as f

ROWS = [
    (1, "SELECT t.a, SUM(b) AS \"x, (y)\", row_number() OVER (PARTITION BY t.a ORDER BY u.c) rn, max(coalesce(u.c, t.d)) m FROM db.big t LEFT JOIN u ON t.a = u.c AND u.k = 'a, b' JOIN v USING (k, l) WHERE 1 = 1 AND t.a BETWEEN 1 AND 2 AND u.c IN ('p', ?) GROUP BY t.a, coalesce(u.c, 1) ORDER BY 1, t.a LIMIT 5"),
    (2, "WITH w AS (SELECT k, max(v) AS v FROM s GROUP BY k) SELECT w.k, *, w.v FROM w -- FROM nowhere"),
    (3, "/* FROM x */ select a from only_one where 2 = 3"),
    (4, None), (5, ""), (6, "delete from t"), (3, "/* FROM x */ select a from only_one where 2 = 3"), (7, "SELECT 1"), (8, "SELECT z.a FROM t, db.y w WHERE 1 = 1"),
]


@pytest.fixture(scope="module")
def facts(spark):
    return f.statements(spark.createDataFrame([(k, q, "clash") for k, q in ROWS], "id long, sql string, b string"), "id", "sql")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_aliases_and_columns(facts):
    assert rows(f.alias_map(facts), "key", "alias", "table_name", "is_cte") == [
        (1, "t", "db.big", False), (1, "u", "u", False), (1, "v", "v", False), (2, "s", "s", False), (2, "w", "w", True), (3, "only_one", "only_one", False), (8, "t", "t", False), (8, "w", "db.y", False),
    ]
    got = {(r.key, r.reference): (r.status, r.field_ref) for r in f.column_facts(facts).collect()}
    assert got[(1, "t.a")] == ("alias", "field://db.big/a") and got[(1, "u.k")] == ("alias", "field://u/k")
    assert got[(1, "b")] == ("unqualified_ambiguous", None) and got[(2, "w.k")] == ("cte", None)
    assert got[(3, "a")] == ("sole_table", "field://only_one/a") and got[(8, "z.a")] == ("unknown_alias", None)
    assert not [k for k in got if k[0] in (4, 5, 6, 7)]


def test_projections(facts):
    got = {(r.key, r.place): (r.output, r.role, r.aggregates, r.windowed, r.fields) for r in f.projection_facts(facts).collect()}
    assert got[(1, 1)] == ("a", "dimension_candidate", "", False, "field://db.big/a")
    assert got[(1, 2)] == ("x, (y)", "measure_candidate", "sum", False, "")
    assert got[(1, 3)][1:4] == ("measure_candidate", "", True)
    assert got[(1, 4)][1:] == ("measure_candidate", "max", False, "field://db.big/d,field://u/c")
    assert got[(2, 2)][1] == "wildcard" and got[(2, 3)][0] == "v" and len([k for k in got if k[0] == 2]) == 3


def test_joins_clauses_and_conjuncts(facts):
    assert rows(f.join_facts(facts), "key", "place", "kind", "target", "condition", "using_columns") == [(1, 1, "left", "u", "t.a = u.c AND u.k = ?", None), (1, 2, "inner", "v", None, "k, l")]
    c = {r.key: r for r in f.clause_facts(facts).collect()}
    assert (c[1].group_by, c[1].order_by, c[1].placeholders) == (2, 2, 3) and c[7].where_text is None
    assert rows(f.conjuncts(facts).filter("key <> 2"), "key", "conjunct") == [(1, "t.a BETWEEN 1 and 2"), (1, "u.c IN (?, ?)"), (3, "2 = 3")]
    assert ("db.big", "a, d") in rows(f.needed_columns(facts), "table_name", "columns")


def test_long_texts_and_empty_tables(spark):
    long = "SELECT " + ", ".join(f"sum(t.c{i}) AS s{i}" for i in range(3000)) + " FROM t"
    df = spark.createDataFrame([(1, long), (2, "SELECT " + "(" * 3000 + " FROM t")], "id long, sql string")
    assert f.projection_facts(f.statements(df, "id", "sql")).filter("key = 1").count() == 3000
    for g in (f.alias_map, f.column_facts, f.projection_facts, f.join_facts, f.clause_facts, f.conjuncts, f.needed_columns):
        assert g(f.statements(df.limit(0), "id", "sql")).count() == 0
