"""Queries for the operators of the reference, each beside its SQL where SQL can say it.

Sums are taken over decimals, so that they do not hang on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sqltext, text
from ..operators import contract, evidence, graph, ranking
from ..operators.current import current_rows
from ..operators.nested import ReportTables
from ..plans.semantic import Measure, Metric, Request, SemanticModel, Table, cube_request, filter_text
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its name, with its SQL if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(24,4))"


def doubles(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


DEVICE_COLUMNS = ["order_date", "year_month", "org_code", "product_l1", "order_amount", "profit_amount", "country", "status"]
CURRENT = "WITH o AS (SELECT * EXCLUDE rn REPLACE (CASE WHEN isnan(profit_amount) THEN NULL ELSE profit_amount END AS profit_amount) FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY loaded_at DESC, load_id DESC) AS rn FROM device_orders) WHERE rn = 1)\n"


def device_model(spark: SparkSession, d: str) -> SemanticModel:
    orders = current_rows(table(spark, d, "device_orders"), "order_id", ["loaded_at", "load_id"], DEVICE_COLUMNS)
    sales = table(spark, d, "sales_orders").distinct()
    confirmed = "status = 'confirmed'"
    dims = {c: c for c in ("org_code", "product_l1", "country", "status", "year_month")}
    return SemanticModel(
        {
            "device_orders": Table(
                orders,
                {"order_amount": Measure(dec("order_amount")), "profit_amount": Measure(dec("profit_amount")), "confirmed_amount": Measure(dec("order_amount"), filter=confirmed), "orders": Measure("1", "count"), "confirmed_orders": Measure("1", "count", confirmed), "organisations": Measure("org_code", "count_distinct"), "losses": Measure("profit_amount < 0", "sum_boolean")},
                dims, {"order_date": "order_date"}, {"device_order": "order_id"},
            ),
            "sales_orders": Table(sales, {"sales_amount": Measure(dec("sales_amount"))}, {"org_code": "org_code", "product_l1": "product_l1"}, {"order_date": "order_date"}, {"sales_order": "sales_order_id"}),
        },
        {
            "order_amount": Metric(measure="order_amount"), "profit_amount": Metric(measure="profit_amount"), "confirmed_amount": Metric(measure="confirmed_amount"), "orders": Metric(measure="orders"),
            "confirmed_orders": Metric(measure="confirmed_orders"), "organisations": Metric(measure="organisations"), "losses": Metric(measure="losses"), "sales_amount": Metric(measure="sales_amount"),
            "german_amount": Metric(measure="order_amount", filter="country = 'DE'"),
            "margin": Metric("ratio", numerator="profit_amount", denominator="order_amount"), "cost": Metric("derived", expr="order_amount - profit_amount", metrics=("order_amount", "profit_amount")),
        },
        {"h1_by_product": Request(("order_amount", "profit_amount"), ("product_l1",), ("org_code = 'ORG_1001'", confirmed, "year_month BETWEEN 202601 AND 202606"))},
    )


def trade_model(spark: SparkSession, d: str) -> SemanticModel:
    t = lambda n: table(spark, d, n)
    return SemanticModel(
        {
            "orders": Table(t("orders"), {"total": Measure(dec("o_totalprice")), "orders": Measure("1", "count")}, {"o_orderpriority": "o_orderpriority", "o_orderstatus": "o_orderstatus"}, {"o_orderdate": "CAST(o_orderdate AS DATE)"}, {"order": "o_orderkey"}, {"customer": "o_custkey"}),
            "customer": Table(t("customer"), {"customers": Measure("1", "count")}, {"c_mktsegment": "c_mktsegment"}, {}, {"customer": "c_custkey"}, {"nation": "c_nationkey"}),
            "nation": Table(t("nation"), {}, {"n_name": "n_name"}, {}, {"nation": "n_nationkey"}, {"region": "n_regionkey"}),
            "region": Table(t("region"), {}, {"r_name": "r_name"}, {}, {"region": "r_regionkey"}),
            "events": Table(t("events"), {"value": Measure(dec("value")), "events": Measure("1", "count")}, {"event_type": "event_type"}, {"ts": "CAST(ts AS DATE)"}),
        },
        {
            "total": Metric(measure="total"), "orders": Metric(measure="orders"), "asian_total": Metric(measure="total", filter="region__r_name = 'ASIA'"), "building_total": Metric(measure="total", filter="customer__c_mktsegment = 'BUILDING'"),
            "value": Metric(measure="value"), "all_time": Metric("cumulative", measure="value"), "trailing_7": Metric("cumulative", measure="value", days=7),
        },
    )


@query(CURRENT + f"SELECT product_l1, sum({dec('order_amount')})::DOUBLE AS order_amount, sum({dec('profit_amount')})::DOUBLE AS profit_amount FROM o WHERE org_code = 'ORG_1001' AND status = 'confirmed' AND year_month BETWEEN 202601 AND 202606 GROUP BY 1")
def flagship_confirmed_by_product(spark: SparkSession, d: str) -> DataFrame:
    return doubles(device_model(spark, d).query("h1_by_product"))


@query(CURRENT + f"SELECT product_l1, sum(CASE WHEN status = 'confirmed' THEN {dec('order_amount')} ELSE 0 END)::DOUBLE AS confirmed_amount, count(CASE WHEN status = 'confirmed' THEN 1 END) AS confirmed_orders, count(*) AS orders, count(DISTINCT org_code) AS organisations, CAST(sum(CAST(profit_amount < 0 AS INTEGER)) AS BIGINT) AS losses FROM o GROUP BY 1")
def conditional_measures(spark: SparkSession, d: str) -> DataFrame:
    return doubles(device_model(spark, d).query(Request(("confirmed_amount", "confirmed_orders", "orders", "organisations", "losses"), ("product_l1",))))


@query(CURRENT + f"SELECT country, floor(sum({dec('profit_amount')})::DOUBLE / nullif(sum({dec('order_amount')})::DOUBLE, 0) * 1000000 + 0.5) / 1000000 AS margin, (sum({dec('order_amount')}) - sum({dec('profit_amount')}))::DOUBLE AS cost FROM o GROUP BY 1")
def ratio_and_derived_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = device_model(spark, d).query(Request(("margin", "cost"), ("country",)))
    return doubles(out.withColumn("margin", F.floor(F.col("margin") * 1000000 + 0.5) / 1000000))


@query(CURRENT + f"SELECT product_l1, sum({dec('order_amount')})::DOUBLE AS order_amount, sum(CASE WHEN country = 'DE' THEN {dec('order_amount')} END)::DOUBLE AS german_amount FROM o GROUP BY 1")
def metric_filter_of_one_metric(spark: SparkSession, d: str) -> DataFrame:
    return doubles(device_model(spark, d).query(Request(("order_amount", "german_amount"), ("product_l1",))))


@query(CURRENT + f"""
, a AS (SELECT product_l1, sum({dec('order_amount')})::DOUBLE AS order_amount FROM o GROUP BY 1),
b AS (SELECT product_l1, sum({dec('sales_amount')})::DOUBLE AS sales_amount FROM (SELECT DISTINCT * FROM sales_orders) GROUP BY 1)
SELECT coalesce(a.product_l1, b.product_l1) AS product_l1, order_amount, sales_amount FROM a FULL JOIN b ON a.product_l1 IS NOT DISTINCT FROM b.product_l1""")
def metrics_of_two_tables(spark: SparkSession, d: str) -> DataFrame:
    return doubles(device_model(spark, d).query(Request(("order_amount", "sales_amount"), ("product_l1",))))


@query(CURRENT + f"SELECT date_trunc('month', order_date)::DATE AS metric_time, product_l1, sum({dec('order_amount')})::DOUBLE AS order_amount FROM o WHERE order_date >= DATE '2026-01-01' AND order_date < DATE '2026-07-01' AND status IN ('confirmed', 'Confirmed') GROUP BY ALL")
def cube_query_time_range(spark: SparkSession, d: str) -> DataFrame:
    q = {"measures": ["order_amount"], "dimensions": ["product_l1"], "timeDimensions": [{"dimension": "order_date", "dateRange": ["2026-01-01", "2026-06-30"], "granularity": "month"}], "filters": [{"member": "status", "operator": "equals", "values": ["confirmed", "Confirmed"]}]}
    return doubles(device_model(spark, d).query(cube_request(q)))


@query(CURRENT + "SELECT country, count(*) AS orders FROM o WHERE org_code = 'ORG_2001' AND year_month BETWEEN 202601 AND 202612 AND order_amount > 100 GROUP BY 1")
def cube_query_string_filters(spark: SparkSession, d: str) -> DataFrame:
    where = tuple(filter_text(f) for f in ("org_code:eq:ORG_2001", {"member": "year_month", "operator": "between", "values": [202601, 202612]}, {"dimension": "order_amount", "operator": "gt", "value": 100}))
    return device_model(spark, d).query(Request(("orders",), ("country",), where))


@query(CURRENT + "SELECT org_code, count(*) AS orders FROM o GROUP BY 1 ORDER BY orders DESC, org_code ASC NULLS LAST LIMIT 10 OFFSET 5")
def ordered_page_of_organisations(spark: SparkSession, d: str) -> DataFrame:
    return device_model(spark, d).query(Request(("orders",), ("org_code",), order=("-orders", "org_code"), limit=10, offset=5))


@query(f"SELECT o_orderpriority, sum({dec('o_totalprice')})::DOUBLE AS total, sum(CASE WHEN r_name = 'ASIA' THEN {dec('o_totalprice')} END)::DOUBLE AS asian_total, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN {dec('o_totalprice')} END)::DOUBLE AS building_total FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def metric_filter_over_hops(spark: SparkSession, d: str) -> DataFrame:
    return doubles(trade_model(spark, d).query(Request(("total", "asian_total", "building_total"), ("o_orderpriority",))))


@query(f"SELECT n_name AS nation__n_name, date_trunc('year', o_orderdate)::DATE AS metric_time, sum({dec('o_totalprice')})::DOUBLE AS total, count(*) AS orders FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def totals_by_nation_and_year(spark: SparkSession, d: str) -> DataFrame:
    return doubles(trade_model(spark, d).query(Request(("total", "orders"), ("nation__n_name",), time="o_orderdate", grain="year")))


def _grain(name: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return doubles(trade_model(spark, d).query(Request(("total",), time="o_orderdate", grain=name)))

    f.__name__ = f"granularity_{name}"
    query(f"SELECT date_trunc('{name}', o_orderdate)::DATE AS metric_time, sum({dec('o_totalprice')})::DOUBLE AS total FROM orders GROUP BY 1")(f)


for _g in ("day", "week", "month", "quarter", "year"):
    _grain(_g)

_SPINE = f"""
WITH e AS (SELECT event_type, ts::DATE AS d, sum({dec('value')}) AS v FROM events GROUP BY ALL),
s AS (SELECT event_type, day::DATE AS d FROM (SELECT DISTINCT event_type FROM e), (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS day FROM e))
SELECT s.event_type, s.d AS metric_time, coalesce(sum(v) OVER (PARTITION BY s.event_type ORDER BY s.d ROWS BETWEEN {{0}} PRECEDING AND CURRENT ROW), 0)::DOUBLE AS {{1}}
FROM s LEFT JOIN e ON e.event_type IS NOT DISTINCT FROM s.event_type AND e.d = s.d"""


@query(_SPINE.format("UNBOUNDED", "all_time"))
def cumulative_all_time(spark: SparkSession, d: str) -> DataFrame:
    return doubles(trade_model(spark, d).query(Request(("all_time",), ("event_type",), time="ts", grain="day")))


@query(_SPINE.format("6", "trailing_7"))
def cumulative_7_days(spark: SparkSession, d: str) -> DataFrame:
    return doubles(trade_model(spark, d).query(Request(("trailing_7",), ("event_type",), time="ts", grain="day")))


@query("SELECT p_type, floor(sum(CAST(p_retailprice AS DECIMAL(24,4)))::DOUBLE / count(p_retailprice) * 10000 + 0.5) / 10000 AS mean_price, max(p_size) AS largest, min(p_size) AS smallest, count(DISTINCT p_brand) AS brands, count(*) AS parts FROM part GROUP BY 1")
def average_and_extremes(spark: SparkSession, d: str) -> DataFrame:
    mean = F.sum(F.expr(dec("p_retailprice"))).cast("double") / F.count("p_retailprice")
    return table(spark, d, "part").groupBy("p_type").agg((F.floor(mean * 10000 + 0.5) / 10000).alias("mean_price"), F.max("p_size").alias("largest"), F.min("p_size").alias("smallest"), F.count_distinct("p_brand").alias("brands"), F.count("*").alias("parts"))


@query("SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(24,4)))::DOUBLE AS quantity, sum(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(6,2))))::DOUBLE AS revenue, count(*) AS lines FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-01-01' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    revenue = F.expr("CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(6,2)))")
    rows = table(spark, d, "lineitem").filter("l_shipdate < TIMESTAMP_NTZ '2001-01-01'")
    return doubles(rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.expr(dec("l_quantity"))).alias("quantity"), F.sum(revenue).alias("revenue"), F.count("*").alias("lines")))


@query("SELECT c_mktsegment, count(*) AS customers FROM customer SEMI JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def customers_with_orders(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    c = table(spark, d, "customer")
    return c.join(done, c["c_custkey"] == done["o_custkey"], "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY 1")
def left_join_keeps_all(spark: SparkSession, d: str) -> DataFrame:
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").filter("s_acctbal > 0")
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_order_of_customer(spark: SparkSession, d: str) -> DataFrame:
    return ranking.keep_first(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem")
def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("place"))


@query("SELECT team, quality, n FROM (SELECT team, quality, count(*) AS n, min(node_id) AS f FROM (SELECT DISTINCT * FROM nodes) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY team ORDER BY n DESC, f) = 1")
def most_common_quality(spark: SparkSession, d: str) -> DataFrame:
    return ranking.mode_first_seen(table(spark, d, "nodes").distinct(), ["team"], "quality", "node_id")


_PAIRS = """
WITH q AS (SELECT DISTINCT node_id, table_names FROM nodes WHERE node_type = 'example_query'),
u AS (SELECT DISTINCT node_id, unnest(table_names) AS t FROM q), v AS (SELECT node_id, t FROM u WHERE t IS NOT NULL AND t <> ''),
j AS (SELECT a.t AS src, b.t AS dst, count(*) AS usage_count FROM v a JOIN v b ON a.node_id = b.node_id AND a.t < b.t GROUP BY ALL)
"""


@query(_PAIRS + ", e AS (SELECT src AS x, dst AS o, * FROM j UNION ALL SELECT dst, src, * FROM j), r AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY x ORDER BY usage_count DESC, o) <= 3) SELECT DISTINCT src, dst, usage_count FROM r")
def closest_tables(spark: SparkSession, d: str) -> DataFrame:
    joins = graph.knowledge_edges(table(spark, d, "nodes")).filter("edge_type = 'joins'")
    return ranking.topk_either_endpoint(joins, "src", "dst", "usage_count", 3)


@query(_PAIRS + """
SELECT src, dst, 'joins' AS edge_type, usage_count FROM j
UNION ALL SELECT node_id, t, 'uses', count(*) FROM v GROUP BY ALL
UNION ALL SELECT user_name, node_id, 'authored', count(*) FROM (SELECT DISTINCT node_id, user_name, table_names FROM nodes WHERE node_type = 'example_query' AND user_name IS NOT NULL) GROUP BY ALL""")
def knowledge_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.knowledge_edges(table(spark, d, "nodes"))


_ACCESS = """
WITH q AS (SELECT DISTINCT node_id, user_name, team, table_names FROM nodes WHERE node_type = 'example_query' AND user_name IS NOT NULL),
a AS (SELECT user_name, t AS table_name, count(*) AS n FROM (SELECT user_name, unnest(table_names) AS t FROM q) WHERE t IS NOT NULL GROUP BY ALL)
"""


def _access(spark: SparkSession, d: str, *by: str) -> DataFrame:
    q = table(spark, d, "nodes").filter("node_type = 'example_query' AND user_name IS NOT NULL").select("node_id", "user_name", "team", "table_names").distinct()
    return q.select(*by, "user_name", F.explode("table_names").alias("table_name")).filter("table_name IS NOT NULL")


@query(_ACCESS + "SELECT user_name, table_name, n, floor(coalesce((n - avg(n) OVER w) / nullif(stddev_pop(n) OVER w, 0), 0) * 10000 + 0.5) / 10000 AS standard FROM a WINDOW w AS (PARTITION BY table_name)")
def standardized_access(spark: SparkSession, d: str) -> DataFrame:
    a = _access(spark, d).groupBy("user_name", "table_name").agg(F.count("*").alias("n"))
    return ranking.standardize(a, "table_name", "n").withColumn("standard", F.floor(F.col("standard") * 10000 + 0.5) / 10000)


@query("WITH q AS (SELECT DISTINCT node_id, user_name, team, table_names FROM nodes WHERE node_type = 'example_query' AND user_name IS NOT NULL) SELECT team, t AS table_name, count(*) AS accesses, count(DISTINCT user_name) AS users FROM (SELECT team, user_name, unnest(table_names) AS t FROM q) WHERE t IS NOT NULL GROUP BY ALL")
def team_access(spark: SparkSession, d: str) -> DataFrame:
    return _access(spark, d, "team").groupBy("team", "table_name").agg(F.count("*").alias("accesses"), F.count_distinct("user_name").alias("users"))


@query("WITH u AS (SELECT DISTINCT team, unnest(table_names) AS t FROM nodes WHERE team IS NOT NULL), v AS (SELECT * FROM u WHERE t IS NOT NULL) SELECT t AS table_name, count(*) AS df, floor(greatest(0.2, 1 - count(*) / (SELECT count(DISTINCT team) FROM v)::DOUBLE) * 10000 + 0.5) / 10000 AS weight FROM v GROUP BY 1")
def table_weights(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "nodes").select("team", F.explode("table_names").alias("table_name"))
    return ranking.document_frequency(used, "team", "table_name").withColumn("weight", F.floor(F.col("weight") * 10000 + 0.5) / 10000)


@query("WITH a AS (SELECT DISTINCT org_code FROM device_orders), b AS (SELECT DISTINCT org_code FROM sales_orders) SELECT 'both' AS part, count(*) AS codes FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'device only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'sales only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def set_operations_on_codes(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "device_orders").select("org_code"), table(spark, d, "sales_orders").select("org_code")
    parts = {"both": a.intersect(b), "device only": a.subtract(b), "sales only": b.subtract(a), "any": a.union(b).distinct()}
    frames = [f.agg(F.count("*").alias("codes")).select(F.lit(n).alias("part"), "codes") for n, f in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


@query(r"""SELECT node_id, nullif(array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(query, '_x000D_\s*', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\r?\n'), lambda x: trim(x)), lambda x: x <> ''), chr(10)), '') AS query FROM nodes WHERE query IS NOT NULL""")
def cleaned_statements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").filter("query IS NOT NULL").select("node_id", text.clean_sql(F.col("query")).alias("query"))


@query(r"SELECT DISTINCT product_code, lower(regexp_replace(regexp_replace(trim(product_name), '(?i)^(?:sum|avg|average|max|min|count)[_\-\s]+', ''), '[\s_\-（）()【】\[\]]+', '', 'g')) AS label FROM product_master")
def normalized_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product_master").select("product_code", text.normalize_label(F.col("product_name")).alias("label")).distinct()


@query("SELECT sha256(text) AS fingerprint, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.count("*").alias("copies"))
    return rows.filter("copies > 1")


@query("SELECT node_id, 'node://' || node_type || '/' || trim(node_id, '/') AS ref FROM nodes")
def node_references(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").select("node_id", text.make_ref("node", F.col("node_type"), F.col("node_id")).alias("ref"))


@query("SELECT attempt_id, min(attempt_id) OVER (PARTITION BY sha256(sql_text)) AS computed_by FROM (SELECT DISTINCT * FROM generation_attempts) WHERE sql_text IS NOT NULL")
def reuse_of_invocations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "generation_attempts").filter("sql_text IS NOT NULL").distinct().select("attempt_id", F.sha2("sql_text", 256).alias("fingerprint"))
    first = rows.groupBy("fingerprint").agg(F.min("attempt_id").alias("computed_by"))
    return rows.join(first, "fingerprint").select("attempt_id", "computed_by")


@query("""WITH k AS (SELECT DISTINCT unnest(table_names) AS t FROM nodes WHERE node_type <> 'example_query'),
u AS (SELECT DISTINCT attempt_id, unnest(used_tables) AS t FROM generation_attempts)
SELECT attempt_id, count(*) AS unknown_tables FROM u WHERE t IS NOT NULL AND t NOT IN (SELECT t FROM k WHERE t IS NOT NULL) GROUP BY 1""")
def unknown_tables_of_attempts(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "nodes").filter("node_type <> 'example_query'").select(F.explode("table_names").alias("t")).distinct()
    used = table(spark, d, "generation_attempts").select("attempt_id", F.explode("used_tables").alias("t")).filter("t IS NOT NULL").distinct()
    return used.join(known, "t", "left_anti").groupBy("attempt_id").agg(F.count("*").alias("unknown_tables"))


@query("SELECT call_id, count(*) AS attempts, min(CASE WHEN is_valid THEN attempt_no END) AS first_valid, max(coalesce(len(error_list), 0)) AS most_errors FROM (SELECT DISTINCT * FROM generation_attempts) GROUP BY 1")
def repair_loops(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "generation_attempts").distinct()
    return rows.groupBy("call_id").agg(F.count("*").alias("attempts"), F.min(F.when(F.col("is_valid"), F.col("attempt_no"))).alias("first_valid"), F.max(F.coalesce(F.array_size("error_list"), F.lit(0))).cast("bigint").alias("most_errors"))


@query("SELECT called_at::DATE AS day, model_name, count(*) AS calls, sum(CASE WHEN success THEN 1 ELSE 0 END)::BIGINT AS succeeded, sum(completion_tokens)::BIGINT AS tokens FROM (SELECT DISTINCT * FROM query_writer_calls) GROUP BY ALL")
def calls_by_day(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "query_writer_calls").distinct()
    return rows.groupBy(F.col("called_at").cast("date").alias("day"), "model_name").agg(F.count("*").alias("calls"), F.sum(F.when(F.col("success"), 1).otherwise(0)).alias("succeeded"), F.sum("completion_tokens").alias("tokens"))


@query("SELECT event_type, count(*) AS events, sum(CAST(props->>'k' AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("k"))


@query("""WITH RECURSIVE links AS (SELECT o_orderkey AS a, min(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS b FROM orders UNION SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) FROM orders),
e AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b), r AS (SELECT DISTINCT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def linked_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    first = lambda *by: F.min("o_orderkey").over(W.partitionBy("o_custkey", *by))
    stars = [o.select(F.col("o_orderkey").alias("a"), first(k).alias("b")) for k in (F.year("o_orderdate"), F.col("o_orderpriority"))]
    return graph.connected_components(stars[0].unionByName(stars[1]), "a", "b")


@query("""WITH q AS (SELECT DISTINCT node_id, user_name, table_names FROM nodes WHERE node_type = 'example_query'),
e AS (SELECT user_name AS a, node_id AS b FROM q WHERE user_name IS NOT NULL UNION SELECT node_id, t FROM (SELECT node_id, unnest(table_names) AS t FROM q) WHERE t IS NOT NULL AND t <> ''),
s AS (SELECT DISTINCT user_name AS root FROM nodes WHERE team = 'device_analytics' AND user_name IS NOT NULL),
h AS (SELECT root, b AS node, 1 AS n FROM s JOIN e ON a = root UNION ALL SELECT root, y.b, 2 FROM s JOIN e x ON x.a = root JOIN e y ON y.a = x.b)
SELECT root, node, min(n)::INTEGER AS hops FROM h WHERE node <> root GROUP BY ALL""")
def reach_of_users(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes")
    edges = graph.knowledge_edges(nodes).filter("edge_type <> 'joins'")
    start = nodes.filter("team = 'device_analytics'").select(F.col("user_name").alias("node"))
    return graph.hops(edges, start, "src", "dst", 2)


@query("SELECT node_type, count(*) AS hits FROM (SELECT DISTINCT node_id, node_type, description, query FROM nodes) WHERE contains(lower(concat_ws(' ', node_id, description, query)), 'ledger') GROUP BY 1")
def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nodes").select("node_id", "node_type", "description", "query").distinct()
    return rows.filter(F.lower(F.concat_ws(" ", "node_id", "description", "query")).contains("ledger")).groupBy("node_type").agg(F.count("*").alias("hits"))


@query()
def statement_facts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sql_text")
    rows = table(spark, d, "generation_attempts").select("attempt_id", "sql_text").distinct()
    return rows.select("attempt_id", sqltext.is_query(s).alias("is_query"), sqltext.tables(s).alias("tables"), sqltext.aggregates(s).alias("aggregates"), sqltext.join_kinds(s).alias("joins"), sqltext.aliases(s).alias("labels"), sqltext.limit_number(s).alias("row_limit"), sqltext.has_window(s).alias("has_window"), sqltext.structural_fingerprint(s).alias("structure"))


@query()
def structural_copies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nodes").filter("query IS NOT NULL").select("node_id", "query").distinct()
    g = rows.groupBy(sqltext.structural_fingerprint(F.col("query")).alias("structure")).agg(F.count("*").alias("statements"), F.count_distinct(sqltext.exact_fingerprint(F.col("query"))).alias("texts"))
    return g.filter("statements > 1")


_BARE = r"trim(regexp_replace(regexp_replace(replace({0}, '_x000D_', ' '), '--[^\n]*|/\*.*?\*/', ' ', 'gs'), '\s+', ' ', 'g'))"


@query(rf"""WITH q AS (SELECT DISTINCT attempt_id, sql_text FROM generation_attempts),
c AS (SELECT unnest(list_transform(regexp_extract_all(regexp_replace({_BARE.format("sql_text")}, '''(?:[^'']|'''')*''|"[^"]*"', '?', 'g'), '(?i)\b([a-z_]\w*)\s*\(', 1), lambda x: lower(x))) AS function FROM q)
SELECT function, count(*) AS calls FROM c WHERE function NOT IN ('in', 'as', 'and', 'or', 'on', 'not', 'exists', 'over', 'by', 'select', 'from', 'where', 'join', 'with', 'values', 'then', 'else', 'when') GROUP BY 1""")
def function_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "generation_attempts").select("attempt_id", "sql_text").distinct()
    return rows.select(F.explode(sqltext.functions(F.col("sql_text"))).alias("function")).groupBy("function").agg(F.count("*").alias("calls"))


@query(rf"""WITH q AS (SELECT DISTINCT attempt_id, sql_text FROM generation_attempts WHERE sql_text IS NOT NULL),
w AS (SELECT regexp_matches(sql_text, '^\s*(--[^\n]*\n\s*)*(select|with)\b', 'is') AS is_query, regexp_extract({_BARE.format("sql_text")}, '(?i)\bwhere\b\s*(.*?)\s*(?:\b(?:group\s+by|order\s+by|having|limit)\b|$)', 1) AS clause FROM q)
SELECT is_query, regexp_matches(clause, '(?i)(?:^|\W)org_code\s*(?:=\s*(?:''[^'']*''|\?|[0-9]+)|in\s*\([^)]*(?:''[^'']*''|\?|[0-9]+))') AS names_org, count(*) AS statements FROM w GROUP BY ALL""")
def mandatory_filter_policy(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sql_text")
    rows = table(spark, d, "generation_attempts").filter("sql_text IS NOT NULL").select("attempt_id", "sql_text").distinct()
    return rows.select(sqltext.is_query(s).alias("is_query"), sqltext.has_equality(s, "org_code").alias("names_org")).groupBy("is_query", "names_org").agg(F.count("*").alias("statements"))


@query()
def evidence_packages(spark: SparkSession, d: str) -> DataFrame:
    return evidence.packages(evidence.evidence_items(ReportTables(table(spark, d, "report_structure"))))


@query()
def claim_audit(spark: SparkSession, d: str) -> DataFrame:
    return evidence.audit_labels(evidence.projection_claims(ReportTables(table(spark, d, "report_structure"))))


@query()
def alignment_candidates(spark: SparkSession, d: str) -> DataFrame:
    return evidence.align_classes(evidence.claims_in_context(ReportTables(table(spark, d, "report_structure"))))


@query()
def similar_table_names(spark: SparkSession, d: str) -> DataFrame:
    """Search by name: the queries are the names whose hash is divisible by 50, against all names."""
    names = table(spark, d, "nodes").select(F.explode("table_names").alias("name")).filter("name IS NOT NULL").distinct()
    names = names.withColumn("text", F.translate("name", "_.", "  "))
    asked = names.filter(F.pmod(F.xxhash64("name"), F.lit(50)) == 0)
    return ranking.tfidf_search(names, asked, "name", "text", 5).withColumn("score", F.round("score", 6))


@query("""WITH k AS (SELECT DISTINCT t, lower(t) AS f FROM (SELECT unnest(table_names) AS t FROM nodes WHERE node_type <> 'example_query') WHERE t IS NOT NULL),
x AS (SELECT f, min(t) AS t FROM k GROUP BY 1), l AS (SELECT string_split(f, '.')[-1] AS leaf, count(DISTINCT f) AS n, min(t) AS t FROM k GROUP BY 1),
u AS (SELECT DISTINCT t FROM (SELECT unnest(used_tables) AS t FROM generation_attempts) WHERE t IS NOT NULL)
SELECT u.t AS table_name, coalesce(x.t, CASE WHEN l.n = 1 THEN l.t END) AS resolved, CASE WHEN x.t IS NOT NULL THEN 'exact' WHEN l.n = 1 THEN 'unique_leaf' WHEN l.n > 1 THEN 'ambiguous_leaf' ELSE 'unmatched' END AS status
FROM u LEFT JOIN x ON x.f = lower(u.t) LEFT JOIN l ON l.leaf = string_split(lower(u.t), '.')[-1]""")
def resolved_tables(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "nodes").filter("node_type <> 'example_query'").select(F.explode("table_names").alias("full"))
    used = table(spark, d, "generation_attempts").select(F.explode("used_tables").alias("table_name")).filter("table_name IS NOT NULL").distinct()
    return ranking.resolve_names(used, "table_name", known, "full")


@query(f"SELECT CASE WHEN order_amount < 0 THEN 'negative' WHEN order_amount = 0 THEN 'zero' WHEN order_amount < 1000 THEN 'small' WHEN order_amount IS NULL THEN 'unknown' ELSE 'large' END AS band, sum(1)::BIGINT AS orders, sum({dec('order_amount')})::DOUBLE AS order_amount FROM (SELECT DISTINCT * FROM deprecated_device_orders) GROUP BY 1")
def amount_bands(spark: SparkSession, d: str) -> DataFrame:
    """A dimension by CASE and a measure that sums ones."""
    a = F.col("order_amount")
    band = F.when(a < 0, "negative").when(a == 0, "zero").when(a < 1000, "small").when(a.isNull(), "unknown").otherwise("large")
    rows = table(spark, d, "deprecated_device_orders").distinct()
    return rows.groupBy(band.alias("band")).agg(F.sum(F.lit(1)).alias("orders"), F.sum(F.expr(dec("order_amount"))).cast("double").alias("order_amount"))


@query("SELECT order_id, arg_min(status, loaded_at) FILTER (WHERE status IS NOT NULL) AS first_status, count(*) AS sent FROM (SELECT DISTINCT order_id, status, loaded_at FROM device_orders) GROUP BY 1 HAVING count(DISTINCT loaded_at) = count(*) AND count(*) > 1")
def first_known_status(spark: SparkSession, d: str) -> DataFrame:
    """Of orders sent more than once, at different times, the first status that is not null."""
    rows = table(spark, d, "device_orders").select("order_id", "status", "loaded_at").distinct()
    known = F.when(F.col("status").isNotNull(), F.struct("loaded_at", "status"))
    g = rows.groupBy("order_id").agg(F.min(known)["status"].alias("first_status"), F.count("*").alias("sent"), F.count_distinct("loaded_at").alias("times"))
    return g.filter("sent > 1 AND times = sent").drop("times")


@query("""SELECT 'nodes' AS table_name, node_type AS kind, count(*) AS records, count(DISTINCT node_id) AS keys FROM nodes GROUP BY 2
UNION ALL SELECT 'query_writer_calls', stage, count(*), count(DISTINCT call_id) FROM query_writer_calls GROUP BY 2
UNION ALL SELECT 'generation_attempts', CASE WHEN is_valid THEN 'valid' ELSE 'not valid' END, count(*), count(DISTINCT attempt_id) FROM generation_attempts GROUP BY 2""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a run: records and keys of each table by kind."""
    valid = F.when(F.col("is_valid"), "valid").otherwise("not valid")
    kinds = [("nodes", F.col("node_type"), "node_id"), ("query_writer_calls", F.col("stage"), "call_id"), ("generation_attempts", valid, "attempt_id")]
    parts = [table(spark, d, n).groupBy(k.alias("kind")).agg(F.count("*").alias("records"), F.count_distinct(key).alias("keys")).select(F.lit(n).alias("table_name"), "kind", "records", "keys") for n, k, key in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


CONTRACT = ["assumptions", "columns", "explanation", "sql", "tables"]


@query("""WITH r AS (SELECT DISTINCT call_id, response FROM query_writer_calls WHERE response LIKE '{%' AND json_valid(response)),
k AS (SELECT call_id, json_keys(response) AS keys, json_type(response, '$.sql') AS kind FROM r)
SELECT call_id, len(list_filter(keys, lambda x: x NOT IN ('assumptions', 'columns', 'explanation', 'sql', 'tables')))::INTEGER AS extra_fields,
  len(list_filter(['assumptions', 'columns', 'explanation', 'sql', 'tables'], lambda x: NOT list_contains(keys, x)))::INTEGER AS missing_fields, coalesce(kind, 'NULL') = 'VARCHAR' AS has_sql FROM k""")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "query_writer_calls").filter("response LIKE '{%'").select("call_id", "response").distinct()
    keys = rows.withColumn("keys", F.json_object_keys("response")).filter("keys IS NOT NULL AND try_parse_json(response) IS NOT NULL")
    allowed = F.array(*[F.lit(c) for c in CONTRACT])
    sql = F.get_json_object("response", "$.sql")
    return keys.select("call_id", F.size(F.filter("keys", lambda k: ~F.array_contains(allowed, k))).alias("extra_fields"), F.size(F.array_except(allowed, F.col("keys"))).alias("missing_fields"), sql.isNotNull().alias("has_sql"))


@query()
def contract_findings(spark: SparkSession, d: str) -> DataFrame:
    """As contract_violations, for every call: fences taken off, the object found in the text, calls without one reported."""
    return contract.findings(table(spark, d, "query_writer_calls"), "call_id", "response", CONTRACT).withColumnRenamed("key", "call_id")
