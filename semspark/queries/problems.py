"""Queries of the general problems 1, 2, 3 and 7, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import loose_code
from ..operators import nested, profile
from ..operators.current import current_rows, union_all
from ..operators.references import find_orphans, orphans_by_period
from ..operators.rolling import rolling_totals
from ..session import materialise, shared_path, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.ReportTables(table(spark, d, "report_structure")).places()


def p1_reports(spark: SparkSession, d: str) -> DataFrame:
    return nested.report_table(nested.ReportTables(table(spark, d, "report_structure")))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return nested.segment_table(nested.ReportTables(table(spark, d, "report_structure")))


def p1_components(spark: SparkSession, d: str) -> DataFrame:
    return nested.component_table(nested.ReportTables(table(spark, d, "report_structure")))


def p1_statements(spark: SparkSession, d: str) -> DataFrame:
    return nested.statement_table(nested.ReportTables(table(spark, d, "report_structure")))


def p1_physical_tables(spark: SparkSession, d: str) -> DataFrame:
    return nested.physical_table_table(nested.ReportTables(table(spark, d, "report_structure")))


def _references(spark: SparkSession, d: str) -> DataFrame:
    new = current_rows(table(spark, d, "device_orders"), "order_id", ["loaded_at", "load_id"], ["product_code", "order_date"])
    old = table(spark, d, "deprecated_device_orders").select("order_id", "product_code", "order_date").distinct()
    tagged = [f.select(F.lit(n).alias("table_name"), "order_id", "product_code", "order_date") for n, f in (("device_orders", new), ("deprecated_device_orders", old))]
    return union_all(tagged)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return find_orphans(_references(spark, d), "product_code", "order_date", table(spark, d, "product_master"), "product_code", "listed_on", "delisted_on")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "order_id", "reason")


def p2_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, d), "order_date", "table_name")


SPECS = [
    profile.ColumnSpec("status", pattern=r"\A(confirmed|cancelled)\z"),
    profile.ColumnSpec("country", pattern=r"\A[A-Z]{2}\z"),
    profile.ColumnSpec("profit_amount", low=-200000.0, high=2000000.0),
]


def _states(spark: SparkSession, d: str) -> DataFrame:
    """States kept by month of arrival and merged."""
    rows, path = table(spark, d, "device_orders"), shared_path(spark, "load_states")
    profile.save_states(rows, "feed_code", "load_id", SPECS, F.date_format("loaded_at", "yyyyMM"), path)
    return materialise(profile.saved_states(rows, "feed_code", "load_id", SPECS, path), "merged_states")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.findings(table(spark, d, "device_orders"), "feed_code", "load_id", SPECS, _states(spark, d))
    return rows.select(F.col("load").alias("load_id"), "column_name", "finding")


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    m = profile.load_metrics(_states(spark, d))
    return m.select(F.col("feed").alias("feed_code"), F.col("load").alias("load_id"), "column_name", "n", "nulls", F.when(F.col("column_name") != "profit_amount", F.col("distinct_values")).alias("distinct_values"), "bad")


def p3_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The whole profile: null rates, distinct counts and ranges of all columns, and medians."""
    m = profile.full_metrics(table(spark, d, "device_orders"), "feed_code", "load_id", SPECS, _states(spark, d))
    return m.select(F.col("feed").alias("feed_code"), F.col("load").alias("load_id"), "column_name", "n", "nulls", (F.col("nulls") / F.col("n")).alias("null_rate"), "distinct_count", "least", "greatest", "low", "high", "median", "bad")


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """Each value of each load with its share of the non-null rows: texts in value, numbers in number."""
    states = _states(spark, d)
    v = profile.value_shares(profile.value_counts(table(spark, d, "device_orders"), "feed_code", "load_id", SPECS, states), profile.load_metrics(states))
    return v.withColumnsRenamed({"feed": "feed_code", "load": "load_id"})


def p3_control_limits(spark: SparkSession, d: str) -> DataFrame:
    c = profile.control_limits(profile.full_metrics(table(spark, d, "device_orders"), "feed_code", "load_id", SPECS, _states(spark, d)))
    return c.select(F.col("feed").alias("feed_code"), F.col("load").alias("load_id"), "column_name", "metric", F.round("figure", 6).alias("figure"), F.round("mean", 6).alias("mean"), "out_of_control")


def _rolling(spark: SparkSession, d: str, each_day: bool = True) -> DataFrame:
    rows = current_rows(table(spark, d, "device_orders"), "order_id", ["loaded_at", "load_id"], ["org_code", "order_date", "order_amount", "profit_amount"])
    return rolling_totals(rows.withColumn("org_code", loose_code(F.col("org_code"))), "org_code", "order_date", ["order_amount", "profit_amount"], each_day=each_day)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _rolling(spark, d).filter((F.col("orders_7") == 0) & (F.col("orders_30") > 0))
    return rows.select(F.col("entity").alias("org_code"), "day_key")


def _rounded(rows: DataFrame, *keys: str) -> DataFrame:
    figures = [c for c in rows.columns if c not in ("entity", *keys)]
    return rows.select(F.col("entity").alias("org_code"), *keys, *[(F.floor(F.col(c) * 10000 + 0.5) / 10000).alias(c) if "_avg_" in c else F.col(c) for c in figures])


def p7_rolling(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rolling(spark, d), "day_key")


def p7_days(spark: SparkSession, d: str) -> DataFrame:
    """Another name of p7_rolling."""
    return p7_rolling(spark, d)


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """The short form: the days of a long silence, all figures nought, are one row from day_key to through_key."""
    return _rounded(_rolling(spark, d, each_day=False), "day_key", "through_key")


QUERIES = {f.__name__: f for f in (p1_found, p1_reports, p1_segments, p1_components, p1_statements, p1_physical_tables, p2_found, p2_by_period, p3_found, p3_profile, p3_ranges, p3_values, p3_control_limits, p7_found, p7_rolling, p7_days, p7_spans)}

_LOOSE = "NULLIF(upper(trim({0}, ' ' || chr(9))), '')"
_CURRENT = "current_orders AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY loaded_at DESC, load_id DESC) rn FROM device_orders) WHERE rn = 1)"
_ORPHANS = f"""
WITH {_CURRENT},
refs AS (
  SELECT 'device_orders' AS table_name, order_id, {_LOOSE.format('product_code')} AS code, order_date FROM current_orders
  UNION ALL
  SELECT DISTINCT 'deprecated_device_orders', order_id, {_LOOSE.format('product_code')}, order_date FROM deprecated_device_orders
), m AS (SELECT DISTINCT {_LOOSE.format('product_code')} AS code, listed_on, delisted_on FROM product_master),
c AS (SELECT code, min(listed_on) AS first_day FROM m WHERE code IS NOT NULL GROUP BY code),
orphans AS (
  SELECT r.*, CASE WHEN c.code IS NULL THEN 'missing' WHEN r.order_date < c.first_day THEN 'later' ELSE 'deleted' END AS reason
  FROM refs r LEFT JOIN c ON r.code = c.code
  WHERE r.code IS NOT NULL AND (c.code IS NULL OR (r.order_date IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM m WHERE m.code = r.code AND m.listed_on <= r.order_date AND (m.delisted_on IS NULL OR m.delisted_on > r.order_date))))
)
"""
_LONG = """
WITH rows AS (SELECT feed_code, load_id, status, country, CASE WHEN isnan(profit_amount) THEN NULL ELSE profit_amount END AS profit FROM device_orders),
long AS (
  SELECT feed_code, load_id, 'status' AS column_name, status AS v, CAST(NULL AS DOUBLE) AS x, status NOT IN ('confirmed', 'cancelled') AS bad FROM rows
  UNION ALL SELECT feed_code, load_id, 'country', country, NULL, NOT regexp_full_match(country, '[A-Z]{2}') FROM rows
  UNION ALL SELECT feed_code, load_id, 'profit_amount', NULL, profit, profit < -200000 OR profit > 2000000 FROM rows
), m AS (
  SELECT feed_code, load_id, column_name, count(*) AS n, sum(CASE WHEN v IS NULL AND x IS NULL THEN 1 ELSE 0 END)::BIGINT AS nulls,
         count(DISTINCT v) AS distinct_values, sum(CASE WHEN bad THEN 1 ELSE 0 END)::BIGINT AS bad, median(x) AS mid
  FROM long GROUP BY ALL
)
"""
_ROLLING = f"""
WITH {_CURRENT},
o AS (SELECT {_LOOSE.format('org_code')} AS org_code, order_date AS d, CAST(order_amount AS DECIMAL(24,4)) AS a,
             CAST(CASE WHEN isnan(profit_amount) THEN NULL ELSE profit_amount END AS DECIMAL(24,4)) AS p FROM current_orders),
daily AS (SELECT org_code, d, count(*) AS n, sum(a) AS a, count(a) AS an, sum(p) AS p, count(p) AS pn FROM o WHERE org_code IS NOT NULL AND d IS NOT NULL GROUP BY ALL),
span AS (SELECT org_code, max(d) AS last_day FROM daily GROUP BY 1),
days AS (SELECT DISTINCT org_code, CAST(d + i AS DATE) AS day FROM daily JOIN span USING (org_code), (SELECT unnest(range(0, 30))::INTEGER AS i) WHERE d + i <= last_day),
gaps AS (SELECT org_code, day, lead(day) OVER (PARTITION BY org_code ORDER BY day) AS nxt FROM days),
cal AS (SELECT org_code, day, day AS through FROM days UNION ALL SELECT org_code, CAST(day + 1 AS DATE), CAST(nxt - 1 AS DATE) FROM gaps WHERE nxt > day + 1),
f AS (
  SELECT c.org_code, c.day, c.through,
    coalesce(sum(n) FILTER (WHERE d > c.day - 7), 0)::BIGINT AS orders_7,
    coalesce(sum(a) FILTER (WHERE d > c.day - 7), 0)::DOUBLE AS at7, sum(an) FILTER (WHERE d > c.day - 7) AS an7,
    coalesce(sum(p) FILTER (WHERE d > c.day - 7), 0)::DOUBLE AS pt7, sum(pn) FILTER (WHERE d > c.day - 7) AS pn7,
    coalesce(sum(n), 0)::BIGINT AS orders_30,
    coalesce(sum(a), 0)::DOUBLE AS at30, sum(an) AS an30, coalesce(sum(p), 0)::DOUBLE AS pt30, sum(pn) AS pn30
  FROM cal c LEFT JOIN daily y ON y.org_code = c.org_code AND y.d <= c.day AND y.d > c.day - 30
  GROUP BY ALL
)
"""
#: A plain calendar of each organisation's span; its rows are days, so windows of rows are windows of days.
_DAYS = f"""
WITH {_CURRENT},
o AS (SELECT {_LOOSE.format('org_code')} AS org_code, order_date AS d, CAST(order_amount AS DECIMAL(24,4)) AS a,
             CAST(CASE WHEN isnan(profit_amount) THEN NULL ELSE profit_amount END AS DECIMAL(24,4)) AS p FROM current_orders),
daily AS (SELECT org_code, d, count(*) AS n, sum(a) AS a, count(a) AS an, sum(p) AS p, count(p) AS pn FROM o WHERE org_code IS NOT NULL AND d IS NOT NULL GROUP BY ALL),
span AS (SELECT org_code, min(d) AS first_day, max(d) AS last_day FROM daily GROUP BY 1),
cal AS (SELECT org_code, CAST(first_day + i AS DATE) AS day FROM (SELECT org_code, first_day, unnest(range(0, last_day - first_day + 1))::INTEGER AS i FROM span)),
f AS (
  SELECT c.org_code, c.day, coalesce(sum(n) OVER w7, 0)::BIGINT AS orders_7, coalesce(sum(n) OVER w30, 0)::BIGINT AS orders_30,
    coalesce(sum(a) OVER w7, 0)::DOUBLE AS at7, sum(an) OVER w7 AS an7, coalesce(sum(p) OVER w7, 0)::DOUBLE AS pt7, sum(pn) OVER w7 AS pn7,
    coalesce(sum(a) OVER w30, 0)::DOUBLE AS at30, sum(an) OVER w30 AS an30, coalesce(sum(p) OVER w30, 0)::DOUBLE AS pt30, sum(pn) OVER w30 AS pn30
  FROM cal c LEFT JOIN daily y ON y.org_code = c.org_code AND y.d = c.day
  WINDOW w7 AS (PARTITION BY c.org_code ORDER BY c.day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY c.org_code ORDER BY c.day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
)
"""


def _key(day: str) -> str:
    return f"CAST(year({day}) * 10000 + month({day}) * 100 + day({day}) AS INTEGER)"


def _items(x: str) -> str:
    """The elements of a JSON value that stands for a list."""
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN [] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END"


_FIELDS = "['report_path', 'report_path_segments', 'components', 'mapping', 'status']"
_FILLED = "json_type({0}) <> 'NULL' AND NOT (json_type({0}) = 'VARCHAR' AND NOT regexp_matches({0} ->> '$', '[^\\s\\p{{Z}}]'))"
def _scalar(x: str) -> str:
    return f"CASE WHEN json_type({x}) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN {x} ->> '$' END"


_RECORD = "record_id, report_id, exported_at, copy_no"
_REPORTS = f"""
WITH raw AS (SELECT *, row_number() OVER (PARTITION BY record_id, report_id, exported_at ORDER BY sha256(doc_json)) AS copy_no
  FROM (SELECT DISTINCT record_id, report_id, exported_at, doc_json FROM report_structure WHERE doc_json IS NOT NULL)),
once AS (SELECT {_RECORD}, doc_json::JSON AS j FROM raw WHERE json_valid(doc_json)),
docs AS (SELECT {_RECORD}, CASE WHEN json_type(j) <> 'VARCHAR' THEN j WHEN json_valid(j ->> '$') THEN (j ->> '$')::JSON END AS j FROM once),
obj AS (SELECT * FROM docs WHERE json_type(j) = 'OBJECT'),
rep AS (SELECT {_RECORD}, CASE WHEN list_has_any(json_keys(j), {_FIELDS}) THEN j ELSE json_extract(j, '$."' || report_id || '"') END AS r FROM obj),
reports AS (SELECT {_RECORD}, r FROM rep WHERE r IS NOT NULL AND json_type(r) = 'OBJECT' AND list_has_any(json_keys(r), {_FIELDS})),
seg AS (SELECT {_RECORD}, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT {_RECORD}, {_items("json_extract(r, '$.report_path_segments')")} AS l FROM reports)),
comp AS (SELECT {_RECORD}, unnest(l) AS x, generate_subscripts(l, 1) AS c FROM (SELECT {_RECORD}, {_items("json_extract(r, '$.components')")} AS l FROM reports)),
ds AS (SELECT {_RECORD}, c, json_extract(x, '$.dataset') AS d FROM comp WHERE json_type(x) = 'OBJECT'),
st AS (SELECT {_RECORD}, c, unnest(l) AS x, generate_subscripts(l, 1) AS s FROM (SELECT {_RECORD}, c,
  CASE WHEN coalesce(json_type(json_extract(d, '$.sql_list')), 'NULL') <> 'NULL' THEN {_items("json_extract(d, '$.sql_list')")} ELSE {_items("json_extract(d, '$.queries')")} END AS l FROM ds WHERE json_type(d) = 'OBJECT')),
said AS (SELECT * FROM st WHERE json_type(x) = 'OBJECT' OR (json_type(x) = 'VARCHAR' AND {_FILLED.format('x')})),
pt AS (SELECT {_RECORD}, c, s, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT {_RECORD}, c, s, {_items("json_extract(x, '$.physical_tables')")} AS l FROM said WHERE json_type(x) = 'OBJECT'))
"""
_PLACES = (
    _REPORTS
    + f"""SELECT DISTINCT record_id, 'segment' AS node_kind, 0 AS component_no, 0 AS statement_no, i::INTEGER AS item_no FROM seg WHERE {_FILLED.format('x')}
UNION ALL SELECT DISTINCT record_id, 'component', c::INTEGER, 0, 0 FROM comp WHERE json_type(x) = 'OBJECT'
UNION ALL SELECT DISTINCT record_id, 'statement', c::INTEGER, s::INTEGER, 0 FROM said
UNION ALL SELECT DISTINCT record_id, 'physical_table', c::INTEGER, s::INTEGER, i::INTEGER FROM pt WHERE {_FILLED.format('x')}
"""
)

SQL = {
    "p1_found": _PLACES,
    "p1_reports": _REPORTS + f"SELECT {_RECORD}, {_scalar("json_extract(r, '$.report_path')")} AS report_path, {_scalar("json_extract(r, '$.status')")} AS status FROM reports",
    "p1_segments": _REPORTS + f"SELECT {_RECORD}, i::INTEGER AS item_no, {_scalar('x')} AS segment FROM seg WHERE {_FILLED.format('x')}",
    "p1_components": _REPORTS + f"""SELECT {_RECORD}, c::INTEGER AS component_no, {_scalar("json_extract(x, '$.component_name')")} AS component_name,
  {_scalar("json_extract(x, '$.dataset.dataset_path')")} AS dataset_path, {_scalar("json_extract(x, '$.dataset.status')")} AS dataset_status FROM comp WHERE json_type(x) = 'OBJECT'""",
    "p1_statements": _REPORTS + f"""SELECT {_RECORD}, c::INTEGER AS component_no, s::INTEGER AS statement_no,
  CASE WHEN json_type(x) = 'OBJECT' THEN {_scalar("json_extract(x, '$.sql')")} ELSE x ->> '$' END AS sql, TRY_CAST({_scalar("json_extract(x, '$.occurrence_count')")} AS BIGINT) AS occurrence_count FROM said""",
    "p1_physical_tables": _REPORTS + f"SELECT {_RECORD}, c::INTEGER AS component_no, s::INTEGER AS statement_no, i::INTEGER AS item_no, {_scalar('x')} AS table_name FROM pt WHERE {_FILLED.format('x')}",
    "p2_found": _ORPHANS + "SELECT table_name, order_id, reason FROM orphans",
    "p2_by_period": _ORPHANS + "SELECT table_name, year(order_date) * 100 + month(order_date) AS month_key, reason, count(*) AS orphans FROM orphans GROUP BY ALL",
    "p3_profile": _LONG + "SELECT feed_code, load_id, column_name, n, nulls, CASE WHEN column_name <> 'profit_amount' THEN distinct_values END AS distinct_values, bad FROM m",
    "p3_ranges": _LONG + """SELECT feed_code, load_id, column_name, count(*) AS n, sum(CASE WHEN v IS NULL AND x IS NULL THEN 1 ELSE 0 END)::BIGINT AS nulls,
  sum(CASE WHEN v IS NULL AND x IS NULL THEN 1 ELSE 0 END)::DOUBLE / count(*)::DOUBLE AS null_rate, count(DISTINCT v) + count(DISTINCT x) AS distinct_count,
  min(v) AS least, max(v) AS greatest, min(x) AS low, max(x) AS high, median(x) AS median, sum(CASE WHEN bad THEN 1 ELSE 0 END)::BIGINT AS bad FROM long GROUP BY ALL""",
    "p3_control_limits": _LONG + """, full_m AS (SELECT m.*, e.distinct_count FROM m JOIN (SELECT load_id, column_name, feed_code, count(DISTINCT v) + count(DISTINCT x) AS distinct_count FROM long GROUP BY ALL) e
  ON e.load_id = m.load_id AND e.column_name = m.column_name AND e.feed_code IS NOT DISTINCT FROM m.feed_code),
rates AS (
  SELECT feed_code, load_id, column_name, 'null_rate' AS metric, nulls::DOUBLE / n::DOUBLE AS figure FROM full_m
  UNION ALL SELECT feed_code, load_id, column_name, 'bad_share', bad::DOUBLE / nullif(n - nulls, 0)::DOUBLE FROM full_m
  UNION ALL SELECT feed_code, load_id, column_name, 'row_count', n::DOUBLE FROM full_m
  UNION ALL SELECT feed_code, load_id, column_name, 'distinct_count', distinct_count::DOUBLE FROM full_m
  UNION ALL SELECT feed_code, load_id, column_name, 'median', mid FROM full_m WHERE mid IS NOT NULL),
h AS (SELECT *, avg(figure) OVER w AS mean_, stddev_pop(figure) OVER w AS sd, count(figure) OVER w AS k FROM rates
  WINDOW w AS (PARTITION BY feed_code, column_name, metric ORDER BY load_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT feed_code, load_id, column_name, metric, round(figure, 6) AS figure, round(CASE WHEN k >= 4 THEN mean_ END, 6) AS mean,
  abs(figure - CASE WHEN k >= 4 THEN mean_ END) > 3 * CASE WHEN k >= 4 THEN sd END + 1e-9::DOUBLE AS out_of_control FROM h""",
    "p3_values": _LONG + """, vc AS (SELECT feed_code, load_id, column_name, v AS value, x AS number, count(*) AS n FROM long WHERE v IS NOT NULL OR x IS NOT NULL GROUP BY ALL)
SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY feed_code, load_id, column_name)::DOUBLE AS share FROM vc""",
    "p3_found": _LONG + """
, b AS (SELECT *, lag(load_id) OVER w AS pl, lag(n) OVER w AS pn, lag(nulls) OVER w AS pnulls, lag(distinct_values) OVER w AS pd, lag(mid) OVER w AS pmid
        FROM m WINDOW w AS (PARTITION BY feed_code, column_name ORDER BY load_id)),
vc AS (SELECT load_id, column_name, v, count(*) AS c FROM long WHERE v IS NOT NULL GROUP BY 1, 2, 3),
shares AS (SELECT load_id, column_name, v, c::DOUBLE / sum(c) OVER (PARTITION BY load_id, column_name)::DOUBLE AS s FROM vc),
cmp AS (
  SELECT b.load_id, b.column_name, s.v, s.s FROM b JOIN shares s ON s.load_id = b.load_id AND s.column_name = b.column_name
  WHERE b.pl IS NOT NULL AND b.nulls < b.n AND b.pnulls < b.pn
  UNION ALL
  SELECT b.load_id, b.column_name, s.v, -s.s FROM b JOIN shares s ON s.load_id = b.pl AND s.column_name = b.column_name
  WHERE b.nulls < b.n AND b.pnulls < b.pn
), shift AS (SELECT load_id, column_name, sum(abs(x)) / 2 AS shift FROM (SELECT load_id, column_name, v, sum(s) AS x FROM cmp GROUP BY ALL) GROUP BY ALL)
SELECT load_id, column_name, 'null_rate' AS finding FROM b WHERE abs(nulls * 1.0::DOUBLE / n - pnulls * 1.0::DOUBLE / pn) > 0.10
UNION ALL SELECT load_id, column_name, 'distinct_count' FROM b WHERE column_name <> 'profit_amount' AND pl IS NOT NULL AND (distinct_values > 2 * pd OR 2 * distinct_values < pd)
UNION ALL SELECT load_id, column_name, CASE WHEN column_name = 'profit_amount' THEN 'range' ELSE 'pattern' END FROM b WHERE bad > 0.05::DOUBLE * (n - nulls)
UNION ALL SELECT load_id, column_name, 'distribution' FROM shift WHERE shift > 0.30::DOUBLE
UNION ALL SELECT load_id, column_name, 'distribution' FROM b WHERE column_name = 'profit_amount' AND abs(mid - pmid) > abs(pmid) * 0.5::DOUBLE
""",
    "p7_found": _DAYS + f"SELECT org_code, {_key('day')} AS day_key FROM f WHERE orders_7 = 0 AND orders_30 > 0",
    "p7_spans": _ROLLING + f"""SELECT org_code, {_key('day')} AS day_key, {_key('through')} AS through_key, orders_7,
  at7 AS order_amount_total_7, floor(at7 / nullif(an7, 0)::DOUBLE * 10000 + 0.5) / 10000 AS order_amount_avg_7, pt7 AS profit_amount_total_7, floor(pt7 / nullif(pn7, 0)::DOUBLE * 10000 + 0.5) / 10000 AS profit_amount_avg_7,
  orders_30, at30 AS order_amount_total_30, floor(at30 / nullif(an30, 0)::DOUBLE * 10000 + 0.5) / 10000 AS order_amount_avg_30, pt30 AS profit_amount_total_30, floor(pt30 / nullif(pn30, 0)::DOUBLE * 10000 + 0.5) / 10000 AS profit_amount_avg_30
FROM f""",
    "p7_rolling": _DAYS + f"""SELECT org_code, {_key('day')} AS day_key, orders_7,
  at7 AS order_amount_total_7, floor(at7 / nullif(an7, 0)::DOUBLE * 10000 + 0.5) / 10000 AS order_amount_avg_7, pt7 AS profit_amount_total_7, floor(pt7 / nullif(pn7, 0)::DOUBLE * 10000 + 0.5) / 10000 AS profit_amount_avg_7,
  orders_30, at30 AS order_amount_total_30, floor(at30 / nullif(an30, 0)::DOUBLE * 10000 + 0.5) / 10000 AS order_amount_avg_30, pt30 AS profit_amount_total_30, floor(pt30 / nullif(pn30, 0)::DOUBLE * 10000 + 0.5) / 10000 AS profit_amount_avg_30
FROM f""",
}
SQL["p7_days"] = SQL["p7_rolling"]
