import io
import json
import math
import random
import re
import zipfile
from collections import Counter
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semspark.functions import sqltext, text
from semspark.operators import evidence, graph, ranking
from semspark.operators.joins import hot_keys, join_unique
from semspark.plans.semantic import Measure, Metric, Request, SemanticModel, Table, cube_request, filter_text
from semspark.sources import readers
from semspark.streaming import query_log


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("code, want", [(" p-1\t", "P-1"), ("", None), (" \t ", None), (None, None), (" a", " A"), ("ß", "SS")])
def test_loose_code(spark, code, want):
    assert one(spark, code, text.loose_code) == want


def test_text_functions(spark):
    assert one(spark, "　 a b  ", text.text_or_null) == "a b" and one(spark, "  ", text.text_or_null) is None
    assert one(spark, "SELECT  1_x000D_ \n\n\n FROM\tt ", text.clean_sql) == "SELECT 1\nFROM t" and one(spark, " \n ", text.clean_sql) is None
    assert one(spark, "/a\\ b //c/", text.path_segments) == ["a", "b", "c"] and one(spark, "/a//c", text.empty_segment_places) == [1, 3]
    assert one(spark, " SUM_Order Amount（元）", text.normalize_label) == "orderamount元"
    assert [one(spark, x, text.is_generic_label) for x in ("c12", "图表3", "LONG_COL_1", "amount", None)] == [True, True, True, False, False]


@settings(max_examples=25, deadline=None)
@given(st.text("ab中_ ", max_size=8), st.text("abc中- ", max_size=8))
def test_char_jaccard_equals_sets(spark, a, b):
    clean = lambda x: set(re.sub(r"[\s_\-]+", "", x).lower())
    x, y = clean(a), clean(b)
    want = len(x & y) / len(x | y) if x and y else 0.0
    got = spark.createDataFrame([(a, b)], "a string, b string").select(text.char_jaccard(F.col("a"), F.col("b")).alias("j")).first().j
    assert math.isclose(got, math.floor(want * 1e4 + 0.5) / 1e4)


def test_redaction(spark):
    assert one(spark, 'curl --token abc123 -d "password": "x y" API_KEY=q', text.redact) == 'curl --token *** -d "password": "*** y" API_KEY=***'


def test_name_resolution(spark, rows):
    known = spark.createDataFrame([("dm.Orders",), ("dm.orders",), ("a.x",), ("b.x",), (None,)], "full string")
    names = spark.createDataFrame([("DM.ORDERS",), ("orders",), ("x",), ("c.x",), ("y",), (None,)], "name string")
    got = {r.name: (r.resolved, r.status) for r in ranking.resolve_names(names, "name", known, "full").collect()}
    assert got == {"DM.ORDERS": ("dm.Orders", "exact"), "orders": ("dm.Orders", "unique_leaf"), "x": (None, "ambiguous_leaf"), "c.x": (None, "ambiguous_leaf"), "y": (None, "unmatched"), None: (None, "unmatched")}


SQLS = {
    "SELECT a.x AS \"月份\", SUM(b.y) AS total FROM dm.t a LEFT JOIN u b ON a.i = b.i WHERE a.org_code = 'ORG_1' AND z IN (1, 2) GROUP BY a.x LIMIT 10": (["dm.t", "u"], ["sum"], ["left"], 10),
    "-- note\nWITH q AS (SELECT * FROM s) SELECT COUNT(*) FROM q JOIN v USING (i)": (["s", "v"], ["count"], ["inner"], None),
    "UPDATE t SET x = 1": ([], [], [], None), "": ([], [], [], None),
}


@pytest.mark.parametrize("sql", SQLS)
def test_sql_facts(spark, sql):
    got = spark.createDataFrame([(sql,)], "s string").select(*[f(F.col("s")) for f in (sqltext.tables, sqltext.aggregates, sqltext.join_kinds, sqltext.limit_number)]).first()
    assert tuple(got) == SQLS[sql]


def test_sql_structure_and_policy(spark):
    first = next(iter(SQLS))
    same = first.replace("ORG_1", "ORG_2").replace("10", "20").lower()
    assert one(spark, first, sqltext.structural) == one(spark, same, sqltext.structural) != one(spark, first + " x", sqltext.structural)
    assert one(spark, first, lambda c: sqltext.has_equality(c, "org_code", "ORG_1")) and not one(spark, first, lambda c: sqltext.has_equality(c, "code"))
    assert one(spark, first, sqltext.aliases) == ["月份", "total"] and one(spark, None, sqltext.is_query) is False
    assert one(spark, "select row_number() over (order by x) from t", sqltext.has_window)


def test_components_of_long_chains_and_hubs(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (None, 3), (7, None), (1, 0), (0, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {n: find(n) for n in root}
    assert graph.connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_hops(spark, rows):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "x")], "s string, t string")
    assert rows(graph.hops(e, spark.createDataFrame([("a",)], "node string"), "s", "t", 3)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]


def test_ranking(spark, rows):
    df = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("a", "y", 5), ("a", "x", 2), ("b", None, 1)], "g string, v string, p int")
    assert rows(ranking.mode_first_seen(df, ["g"], "v", "p")) == [("a", "y", 2), ("b", None, 1)]
    assert rows(ranking.keep_first(df, ["g"], [F.col("p")]).select("g", "p")) == [("a", 1), ("b", 1)]
    pairs = spark.createDataFrame([("a", "b", 3.0), ("a", "c", 2.0), ("b", "c", 1.0), ("c", "d", 0.5)], "x string, y string, s double")
    assert rows(ranking.topk_either_endpoint(pairs, "x", "y", "s", 1)) == [("a", "b", 3.0), ("a", "c", 2.0), ("c", "d", 0.5)]


def char_wb(s, lo=2, hi=4):
    out = []
    for w in re.sub(r"\s+", " ", s.lower()).split():
        w = f" {w} "
        for n in range(lo, hi + 1):
            out.append(w[:n])
            at = 0
            while at + n < len(w):
                at += 1
                out.append(w[at : at + n])
            if at == 0:
                break
    return out


@settings(max_examples=25, deadline=None)
@given(st.text("abc中 ", max_size=14))
def test_char_grams(spark, s):
    assert Counter(one(spark, s, ranking.char_grams)) == Counter(char_wb(s))


def test_search_agrees_with_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(["device orders fact", "device order", "sales orders", "product master", "", "orders of devices", "sensor depot ledger"])]
    tf = {i: {g: 1 + math.log(n) for g, n in Counter(char_wb(t)).items()} for i, t in docs}
    df = Counter(g for v in tf.values() for g in v)
    w = {i: {g: x * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g, x in v.items()} for i, v in tf.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in w.items()}
    want = sorted(((sum(x * w[j].get(g, 0) for g, x in w[0].items()) / norm[0] / norm[j], j) for j in w if j and norm[j]), key=lambda p: (-round(p[0], 9), p[1]))
    d = spark.createDataFrame(docs, "id int, t string")
    got = [(r.id, r.score) for r in ranking.tfidf_search(d, d.filter("id = 0"), "id", "t", 3).orderBy("rank").collect()]
    assert [g[0] for g in got] == [j for _, j in want[:3]] and all(math.isclose(g[1], s) for g, (s, _) in zip(got, want))


def best_by_brute_force(docs, asked, k):
    """(query, key, score) of the k best, over rows (key, text) of which several may have one key."""
    grams = {}
    for i, t in docs:
        grams.setdefault(i, Counter()).update(char_wb(t or ""))
    df, n = Counter(g for v in grams.values() for g in v), sum(i is not None for i in grams)
    w = {i: {g: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[g])) + 1) for g, c in v.items()} for i, v in grams.items() if i is not None}
    w = {i: {g: x / math.sqrt(sum(y * y for y in v.values())) for g, x in v.items()} for i, v in w.items()}
    out = []
    for q in asked:
        scores = [(-round(sum(x * v[g] for g, x in w[q].items() if g in v), 9), i) for i, v in w.items() if i != q]
        out += [(q, i, s) for s, i in sorted(x for x in scores if x[0] < 0)[:k]]
    return out


@pytest.mark.parametrize("shard_chars", [400, 3_000, 1_000_000])
def test_search_over_many_shards_agrees_with_brute_force(spark, shard_chars):
    r = random.Random(4)
    pool = ["order", "orders", "device", "device2", "fact", "aa", "a", "中中文", "ledger", "ledgers", "stat", "static", "ⅷ", "Fleet"]
    docs = [(f"k{i:03}", " ".join(r.choices(pool, k=r.choice([1, 2, 3, 4, 40])))) for i in range(400)]
    docs += [("k000", "fleet fleet"), ("k001", None), ("z", None), ("y", " "), ("x", "unlike"), (None, "device fact"), *[(f"tie{i}", "order device fact") for i in range(9)]]
    asked = [*[f"k{i:03}" for i in range(0, 400, 9)], "k001", "z", "x", "tie4"]
    d = spark.createDataFrame(docs, "id string, t string")
    q = spark.createDataFrame([(x,) for x in [*asked, "tie4", "absent", None]], "id string")
    got = ranking.tfidf_search(d, q, "id", "t", 4, shard_chars).orderBy("query", "rank").collect()
    want = sorted(best_by_brute_force(docs, sorted(set(asked)), 4), key=lambda x: (x[0], x[2], x[1]))
    assert [(x.query, x.id) for x in got] == [x[:2] for x in want]
    assert all(math.isclose(x.score, -w[2], abs_tol=1e-8) for x, w in zip(got, want))


def test_search_shuffles_documents_and_not_their_postings(spark):
    r = random.Random(5)
    pool = [f"{a}{b}" for a in ("de", "or", "led", "fl", "mar", "con") for b in ("vice", "der", "ger", "eet", "gin", "tract")]
    docs = [(i, " ".join(r.choices(pool, k=4))) for i in range(2_000)]
    d = spark.createDataFrame(docs, "id int, t string")
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        got = sc.statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return {got.apply(i).stageId(): got.apply(i).shuffleWriteRecords() for i in range(got.size())}

    old = stages()
    assert ranking.tfidf_search(d, d.filter("id % 50 = 0"), "id", "t", 5).count() == 200
    assert sum(n for i, n in stages().items() if i not in old) < 20 * len(docs)


def test_join_of_hot_keys(spark):
    left = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 'hot', CAST(id % 50 AS STRING)) AS k")
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("99", 3)], "k string, v int")
    assert hot_keys(left, "k", 0.1, 500) == ["hot"]
    for how in ("inner", "left"):
        assert join_unique(left, right, "k", how, share=0.1, least=500).groupBy("v").count().orderBy("v").collect() == left.join(right, "k", how).groupBy("v").count().orderBy("v").collect()


def test_grades(spark):
    kinds = {"A": ["sql_projection", "field_lineage"], "B": ["sql_filter"], "C": ["sql_projection"], "U": ["sql_query"]}
    kinds2 = {"B": ["sql_projection", "report_path"], "C": ["report_path", "component_name"], "U": []}
    for k in (kinds, kinds2):
        for want, own in k.items():
            assert one(spark, own, evidence.grade, "array<string>") == want


ORDERS = [("2026-01-05", "ORG_1001", "Compute", "confirmed", 3000.0, 700.0), ("2026-02-05", "ORG_1001", "Compute", "confirmed", 4500.0, 860.0), ("2026-06-30", "ORG_1001", "IoT", "confirmed", 3400.0, 650.0), ("2026-03-01", "ORG_1001", "IoT", "cancelled", 9999.0, 999.0), ("2026-03-01", "ORG_2002", "IoT", "confirmed", 1.0, 1.0), ("2026-07-01", "ORG_1001", "IoT", "confirmed", 5.0, 5.0), (None, "ORG_3", None, None, None, None)]


def model(spark):
    t = spark.createDataFrame(ORDERS, "d string, org string, l1 string, status string, amount double, profit double").withColumn("d", F.to_date("d"))
    orgs = spark.createDataFrame([("ORG_1001", "DE"), ("ORG_2002", "CN")], "org string, land string")
    tables = {
        "orders": Table(t, {"amount": Measure("amount"), "confirmed": Measure("amount", filter="status = 'confirmed'"), "profit": Measure("profit"), "n": Measure("1", "count")}, {"l1": "l1", "status": "status", "org": "org"}, {"d": "d"}, {}, {"organisation": "org"}),
        "orgs": Table(orgs, {"organisations": Measure("1", "count")}, {"land": "land"}, {}, {"organisation": "org"}),
    }
    metrics = {"amount": Metric(measure="amount"), "confirmed": Metric(measure="confirmed"), "profit": Metric(measure="profit"), "margin": Metric("ratio", numerator="profit", denominator="amount"), "double_margin": Metric("derived", expr="margin * 2", metrics=("margin",)), "so_far": Metric("cumulative", measure="amount"), "german": Metric(measure="amount", filter="organisation__land = 'DE'"), "broken": Metric(measure="amount", filter="nothing = 1")}
    return SemanticModel(tables, metrics, {"h1": Request(("amount", "profit"), ("l1",), ("org = 'ORG_1001'", "status = 'confirmed'"), "d", "2026-01-01", "2026-06-30")})


def test_golden_question(spark, rows):
    m = model(spark)
    assert rows(m.query("h1")) == [("Compute", 7500.0, 1560.0), ("IoT", 3400.0, 650.0)]
    cube = {"measures": ["amount"], "dimensions": ["l1"], "timeDimensions": [{"dimension": "d", "dateRange": ["2026-01-01", "2026-06-30"]}], "filters": [{"member": "org", "operator": "equals", "values": ["ORG_1001"]}, {"member": "status", "operator": "equals", "values": ["confirmed"]}], "order": {"amount": "desc"}}
    assert [tuple(r) for r in m.query(cube_request(cube)).collect()] == [("Compute", 7500.0), ("IoT", 3400.0)]
    assert filter_text("org:eq:it's") == "org = 'it\\'s'" and filter_text("x:in:a,b") == "x IN ('a', 'b')"
    assert "PushedFilters" in m.explain("h1") or "Filter" in m.explain("h1")


def test_metric_kinds(spark, rows):
    m = model(spark)
    assert rows(m.query(Request(("confirmed", "margin", "double_margin", "german"), ("organisation__land",)))) == sorted([("DE", 10905.0, 3214 / 20904, 2 * 3214 / 20904, 20904.0), ("CN", 1.0, 1.0, 2.0, None), (None, 0.0, None, None, None)], key=repr)
    days = m.query(Request(("so_far",), time="d", grain="day", where=("d IS NOT NULL",))).collect()
    assert len(days) == 178 and days[-1] is not None and max(r.so_far for r in days) == sum(r[4] or 0 for r in ORDERS)
    assert set(m.validate()) == {"broken"} and "organisation__land" in m.list_metrics()["amount"]
    assert m.query(Request(("amount",), ("l1",), order=("-amount",), limit=1, offset=1)).count() == 1


def test_readers(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("id,x\n1,a\n ,b\n2,\n")
    assert rows(readers.read_csv(spark, f"file://{tmp_path}/a.csv", key="id").select("id")) == [("1",), ("2",)]
    (tmp_path / "a.jsonl").write_text('{"q": "中"}\n\n{"q": null}\n')
    assert readers.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "q string").count() == 2
    assert readers.read_jsonl(spark, f"file://{tmp_path}/none.jsonl", "q string").count() == 0
    assert readers.day_spine(spark, "2024-02-27", "2024-03-02").count() == 4 and readers.day_spine(spark, "2024-01-02", "2024-01-02").count() == 0
    assert readers.file_snapshot(spark, f"file://{tmp_path}/a.csv").first().size == 16
    readers.write_csv(readers.read_json(spark, f"file://{tmp_path}/a.jsonl", "q string"), f"file://{tmp_path}/out")
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t> path </t></si><si><t>名称</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="C2" t="inlineStr"><is><t>b</t></is></c></row><row r="3"><c r="A3"><v> </v></c></row><row r="5"><c r="A5"><v>7</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(sheet.getvalue())
    spark.dataSource.register(readers.WorkbookSource)
    assert rows(spark.read.format("workbook").option("columns", "path,名称").load(str(tmp_path / "a.xlsx"))) == [("7", None, 5), (None, "b", 2)]


def test_stream_counts_each_statement_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    at = lambda h, m: datetime(2026, 1, 1, h, m).isoformat()
    line = lambda q, t: json.dumps({"query": q, "timestamp": t, "user": "u"})
    (log / "1.json").write_text("\n".join([line("SELECT 1 FROM a", at(1, 5)), line("SELECT 1 FROM a", at(1, 5)), line("SELECT 1 FROM a JOIN b", at(1, 50)), line("SELECT 1 FROM a", at(9, 0))]))
    q = query_log.windowed_usage(query_log.read_log(spark, f"file://{log}")).writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start.hour, r.table): r.queries for r in spark.table("usage").collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (9, "a"): 1}
