import json
from datetime import datetime

import pytest

from semspark.operators import assets, sqlfacts
from semspark.operators.nested import ReportTables

AT = datetime(2026, 1, 1)


def component(name, dataset, *sql):
    return {"component_name": name, "dataset": {"dataset_path": dataset, "sql_list": [{"sql": q} for q in sql]}}


DOCS = [
    ("R1", {"report_path": "a/【202601】Profit", "mapping": {"cn_name": "Profit"}, "components": [component("x", "d//e", "SELECT 1", "SELECT 1", None), component("x", "d/f")]}),
    ("R2", {"report_path": " \t", "components": [component("y", "d"), component("y", "d"), component(None, "e"), component(None, "f")]}),
    ("R3", {"report_path": "a//Stock 12", "mapping": {"cn_name": "Stock"}}),
    ("R4", {"report_path": "b/Profit", "status": "ok"}),
    ("R5", {"report_path": "b/Nothing", "mapping": {"cn_name": " "}}),
]
SCHEMA = "record_id long, report_id string, exported_at timestamp, doc_json string, node int"


@pytest.fixture(scope="module")
def reports(spark):
    rows = [(i, r, AT, json.dumps(doc), 7) for i, (r, doc) in enumerate(DOCS, 1)]
    return ReportTables(spark.createDataFrame([*rows, rows[0], (6, None, None, None, 7)], SCHEMA))


def test_assets(reports):
    got = {r.record_id: (r.title, r.mapped, r.found_by, r.identity_status, r.issues) for r in assets.report_assets(reports).collect()}
    assert got == {
        1: ("【202601】Profit", "Profit", "without_period", "source_mapped", "dataset_path_empty_segment"),
        2: (None, None, "none", "provisional_missing", "missing_report_path"),
        3: ("Stock 12", "Stock", "normalized", "source_mapped", "report_path_empty_segment"),
        4: ("Profit", "Profit", "exact", "source_mapped", ""),
        5: ("Nothing", None, "none", "provisional_path", ""),
    }


def test_names_groups_and_counters(reports):
    assert [(r.record_id, r.component_name, r.components, r.datasets) for r in assets.name_anomalies(reports).collect()] == [(1, "x", 2, 2)]
    assert [(r.record_id, r.statements, r.occurrences, r.places) for r in assets.statement_groups(reports).collect()] == [(1, 2, 2, "1,2")]
    got = {(r.asset, r.status): (r.assets, r.unnamed) for r in assets.asset_summary(reports).collect()}
    assert got == {("report", None): (4, 1), ("report", "ok"): (1, 0), ("component", None): (6, 2), ("statement", None): (3, 1)}


def test_two_names_of_one_key_map_nothing(spark):
    names = spark.createDataFrame([("Sales 1",), ("Sales 2",), ("",), (None,), ("Sales 1",)], "n string")
    titles = spark.createDataFrame([("Sales 3", 1), ("Sales 1", 2), (None, 3), ("Sales 1", 2)], "t string, k int")
    got = sorted((r.k, r.mapped, r.found_by) for r in assets.lookup_titles(titles, "t", names, "n").collect() if r.k != 3)
    assert got == [(1, None, "none"), (2, "Sales 1", "exact"), (2, "Sales 1", "exact")]


def test_concepts(spark):
    texts = [
        (1, 'SELECT a AS "Org", SUM(b) AS "Sum_Profit" FROM t'), (2, "SELECT x.a AS org, sum(x.b) AS profit FROM t x"), (3, 'SELECT max(b) AS "profit", c1 AS c1 FROM t'),
        (4, "SELECT a AS ORG, * FROM u"), (5, None), (6, ""), (1, 'SELECT a AS "Org", SUM(b) AS "Sum_Profit" FROM t'), (7, "SELECT a AS org FROM t, u"),
    ]
    claims = assets.concept_claims(spark.createDataFrame([(i, q, "clash") for i, q in texts], "id long, sql string, role string"), "id", "sql")
    got = sorted((r.role, r.normalized, r.label, r.members) for r in assets.merged_concepts(claims).collect())
    assert got == [("dimension", "org", "Org", 2), ("measure", "profit", "Sum_Profit", 2)]
    pairs = {r.role: (r.claims, r.all_pairs, r.label_pairs, r.safe_pairs, r.kept_share) for r in assets.pair_reduction(claims).collect()}
    assert pairs == {"dimension": (3, 3, 3, 1, 1.0), "measure": (3, 3, 3, 1, 1.0)}
    assert assets.merged_concepts(claims.limit(0)).count() == 0 and assets.pair_reduction(claims.limit(0)).count() == 0


def test_a_field_implies_its_table(spark):
    s = sqlfacts.statements(spark.createDataFrame([(1, "SELECT t.a FROM db.T t JOIN u ON t.a = u.b")], "id long, sql string"), "id", "sql")
    assert sorted(r.ref for r in assets.asset_refs(s).collect()) == ["field://db.t/a", "field://u/b", "table://db.t", "table://u"]
