import json

import duckdb
from pyspark.sql import functions as F

from semspark.operators.nested import ReportTables, component_table, physical_table_table, report_table, segment_table, shred, statement_table

SCHEMA = "record_id long, report_id string, exported_at timestamp, doc_json string, node int, label string"
FIELDS = {"report_path", "report_path_segments", "components", "mapping", "status"}


def tables(spark, docs):
    return ReportTables(spark.createDataFrame([(i, f"R{i}", None, d, 1, "x") for i, d in docs], SCHEMA))


def as_list(v):
    return v if isinstance(v, list) else [] if v is None else [v]


def filled(x):
    return x is not None and not (isinstance(x, str) and not x.strip())


def brute(records):
    out = set()
    for rid, rep, doc in records:
        try:
            v = json.loads(doc)
            v = json.loads(v) if isinstance(v, str) else v
        except (ValueError, TypeError):
            continue
        if not isinstance(v, dict):
            continue
        r = v if FIELDS & set(v) else v.get(rep)
        if not isinstance(r, dict) or not FIELDS & set(r):
            continue
        out |= {(rid, "segment", 0, 0, i) for i, x in enumerate(as_list(r.get("report_path_segments")), 1) if filled(x)}
        for c, x in enumerate(as_list(r.get("components")), 1):
            if isinstance(x, dict):
                out.add((rid, "component", c, 0, 0))
                ds = x.get("dataset") if isinstance(x.get("dataset"), dict) else {}
                for s, st in enumerate(as_list(ds["sql_list"] if ds.get("sql_list") is not None else ds.get("queries")), 1):
                    if isinstance(st, dict) or isinstance(st, str) and st.strip():
                        out.add((rid, "statement", c, s, 0))
                        for t, p in enumerate(as_list(st.get("physical_tables") if isinstance(st, dict) else None), 1):
                            if filled(p):
                                out.add((rid, "physical_table", c, s, t))
    return out


def test_places_of_odd_documents(spark, rows):
    comp = {"component_name": "a", "dataset": {"sql_list": [None, " ", "SELECT 1", {"sql": "x", "physical_tables": "t"}, {"physical_tables": ["a", "", None, {"name": "b"}]}]}}
    doc = {"report_path_segments": ["a", "", " ", None, "b"], "components": [None, "text", comp, {"dataset": None}, {"dataset": {"queries": {"sql": "y"}}}]}
    docs = [
        (1, json.dumps(doc)), (2, json.dumps(json.dumps({"R2": doc}))), (3, json.dumps({"R9": doc})), (4, "{bad"), (5, None), (6, "null"), (7, "[]"), (8, ""),
        (9, json.dumps({"components": comp})), (10, json.dumps({"status": None})), (11, json.dumps({"error": 1})), (12, json.dumps({"report_path_segments": "one"})), (1, json.dumps(doc)),
    ]
    got = rows(tables(spark, docs).places())
    assert set(got) == brute([(i, f"R{i}", d) for i, d in docs]) and len(got) == len(set(got))


def test_places_agree_with_brute_force(spark, rows, small):
    t = ReportTables(spark.read.parquet(f"{small}/report_structure.parquet"))
    want = brute(duckdb.sql(f"SELECT record_id, report_id, doc_json FROM '{small}/report_structure.parquet'").fetchall())
    assert set(rows(t.places())) == want
    assert component_table(t).count() == sum(w[1] == "component" for w in want)
    assert statement_table(t).filter("sql IS NOT NULL").count() > 0


def test_round_trip_of_adjacency_rows(spark):
    doc = {"a": [1, 2.5, True, None, {"b": "x" * 100_000}], "é": {"c": []}}
    nodes = shred(spark.createDataFrame([(1, json.dumps(doc))], "id long, doc string"), ["id"], "doc").toPandas()
    kids = {p: g.sort_values("ordinal") for p, g in nodes.groupby("parent")}

    def back(row):
        own = kids.get(row.node)
        own = [] if own is None else list(own.itertuples())
        if row.kind == "object":
            return {c.label: back(c) for c in own}
        if row.kind == "array":
            return [back(c) for c in own]
        return row.scalar if row.kind == "string" else None if row.kind == "null" else json.loads(row.scalar)

    assert back(next(nodes[nodes.parent == 0].itertuples())) == doc


def test_empty_table(spark):
    t = tables(spark, [])
    assert t.places().count() == 0 and component_table(t).count() == 0


def test_two_records_of_one_id_stay_apart(spark):
    a, b = json.dumps({"components": [{}, {}]}), json.dumps({"components": [{}]})
    t = tables(spark, [(1, a), (1, b)])
    assert t.components().count() == 3 and t.places().filter(F.col("node_kind") == "component").count() == 2
    assert sorted((r.copy_no, r.component_no) for r in component_table(t).collect()) in ([(1, 1), (1, 2), (2, 1)], [(1, 1), (2, 1), (2, 2)])
    assert {(r.record_id, r.report_id, r.copy_no) for r in report_table(t).collect()} == {(1, "R1", 1), (1, "R1", 2)}


def test_rows_of_two_versions_are_tied_to_their_own_report(spark, rows):
    one = {"report_path": "/a", "status": 5, "report_path_segments": ["x", {"y": 1}], "components": [{"component_name": "c", "dataset": {"dataset_path": "d", "sql_list": [{"sql": "s", "occurrence_count": "7", "physical_tables": ["t", None, "u"]}, "text"]}}]}
    two = {"report_path": "/b", "components": {"component_name": 12345678901234567890.12345678901234567890}}
    df = spark.createDataFrame([(1, "R1", f"2025-01-0{i}", json.dumps(d) if i == 1 else json.dumps(d).replace("1.2345678901234567e+19", "12345678901234567890.12345678901234567890"), 1, "x") for i, d in ((1, one), (2, two))], SCHEMA.replace("timestamp", "string"))
    t = ReportTables(df)
    a, b = (1, "R1", "2025-01-01", 1), (1, "R1", "2025-01-02", 1)
    assert rows(report_table(t)) == [(*a, "/a", "5"), (*b, "/b", None)]
    assert rows(segment_table(t)) == [(*a, 1, "x"), (*a, 2, None)]
    assert rows(component_table(t)) == [(*a, 1, "c", "d", None), (*b, 1, "12345678901234567890.12345678901234567890", None, None)]
    assert rows(statement_table(t)) == [(*a, 1, 1, "s", 7), (*a, 1, 2, "text", None)]
    assert rows(physical_table_table(t)) == [(*a, 1, 1, 1, "t"), (*a, 1, 1, 3, "u")]
