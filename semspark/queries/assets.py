"""Queries for reports as assets, concepts, run records and validation, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assets, sqlfacts
from ..operators.nested import ReportTables, statement_table
from ..operators.ranking import keep_first
from ..session import table
from .mining import _FACTS, _PROJECTIONS, _REF, _refs
from .problems import SQL as REPORTS

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


def _reports(spark: SparkSession, d: str) -> ReportTables:
    return ReportTables(table(spark, d, "report_structure"))


_TEXT = r"nullif(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '')"
_KEY = r"regexp_replace(lower(regexp_replace(regexp_replace(trim({0}), '(?i)^(?:sum|avg|average|max|min|count)[_\-\s]+', ''), '[\s_\-（）()【】\[\]]+', '', 'g')), '[0-9]+$', '')"
_PARTS = r"list_transform(string_split(replace({0}, chr(92), '/'), '/'), lambda x: trim(x))"
_MAPPINGS = REPORTS["p1_reports"][: REPORTS["p1_reports"].rindex("SELECT record_id")] + "SELECT DISTINCT json_extract(r, '$.mapping.cn_name') ->> '$' AS name FROM reports WHERE json_type(json_extract(r, '$.mapping.cn_name')) NOT IN ('OBJECT', 'ARRAY', 'NULL')"


@query(rf"""WITH r AS ({REPORTS["p1_reports"]}), c AS ({REPORTS["p1_components"]}), m AS (SELECT name FROM ({_MAPPINGS}) WHERE {_TEXT.format("name")} IS NOT NULL),
k AS (SELECT {_KEY.format("name")} AS key, min(name) AS name FROM m GROUP BY 1 HAVING count(*) = 1),
bad AS (SELECT DISTINCT record_id, report_id, exported_at, copy_no FROM c WHERE list_contains({_PARTS.format("dataset_path")}, '')),
p AS (SELECT record_id, report_id, exported_at, copy_no, {_TEXT.format("report_path")} AS path, list_filter({_PARTS.format(_TEXT.format("report_path"))}, lambda x: x <> '')[-1] AS title FROM r),
f AS (SELECT p.*, a.name AS a, b.name AS b, k.name AS c FROM p LEFT JOIN m a ON a.name = title LEFT JOIN m b ON b.name = regexp_replace(title, '^【[0-9]{{6}}】', '') LEFT JOIN k ON k.key <> '' AND k.key = {_KEY.format("regexp_replace(title, '^【[0-9]{6}】', '')")})
SELECT record_id, report_id, exported_at, copy_no, path, title, coalesce(a, b, c) AS mapped, CASE WHEN a IS NOT NULL THEN 'exact' WHEN b IS NOT NULL THEN 'without_period' WHEN c IS NOT NULL THEN 'normalized' ELSE 'none' END AS found_by,
CASE WHEN coalesce(a, b, c) IS NOT NULL THEN 'source_mapped' WHEN path IS NOT NULL THEN 'provisional_path' ELSE 'provisional_missing' END AS identity_status,
concat_ws(',', CASE WHEN path IS NULL THEN 'missing_report_path' END, CASE WHEN list_contains({_PARTS.format("path")}, '') THEN 'report_path_empty_segment' END,
  CASE WHEN EXISTS (SELECT 1 FROM bad WHERE bad.record_id = f.record_id AND bad.copy_no = f.copy_no AND bad.report_id IS NOT DISTINCT FROM f.report_id AND bad.exported_at IS NOT DISTINCT FROM f.exported_at) THEN 'dataset_path_empty_segment' END) AS issues FROM f""")
def report_assets(spark: SparkSession, d: str) -> DataFrame:
    return assets.report_assets(_reports(spark, d))


@query(f"""WITH c AS ({REPORTS["p1_components"]}) SELECT record_id, report_id, exported_at, copy_no, component_name, count(*) AS components, count(DISTINCT dataset_path) AS datasets
FROM c WHERE {_TEXT.format("component_name")} IS NOT NULL GROUP BY ALL HAVING count(DISTINCT dataset_path) > 1""")
def component_name_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return assets.name_anomalies(_reports(spark, d))


@query(f"""WITH s AS ({REPORTS["p1_statements"]}) SELECT record_id, report_id, exported_at, copy_no, component_no, sha256(sql) AS fingerprint, count(*) AS statements, sum(coalesce(occurrence_count, 1))::BIGINT AS occurrences,
array_to_string(list_sort(list(DISTINCT statement_no)), ',') AS places FROM s WHERE sql IS NOT NULL GROUP BY ALL""")
def statement_groups(spark: SparkSession, d: str) -> DataFrame:
    return assets.statement_groups(_reports(spark, d))


@query(f"""SELECT 'report' AS asset, status, count(*) AS assets, count(*) FILTER (WHERE {_TEXT.format("report_path")} IS NULL) AS unnamed FROM ({REPORTS["p1_reports"]}) GROUP BY ALL
UNION ALL SELECT 'component', dataset_status, count(*), count(*) FILTER (WHERE {_TEXT.format("component_name")} IS NULL) FROM ({REPORTS["p1_components"]}) GROUP BY ALL
UNION ALL SELECT 'statement', NULL, count(*), count(*) FILTER (WHERE {_TEXT.format("sql")} IS NULL) FROM ({REPORTS["p1_statements"]})""")
def asset_summary(spark: SparkSession, d: str) -> DataFrame:
    return assets.asset_summary(_reports(spark, d))


@query(f"""{_FACTS},\n{_refs('(SELECT *, 0 AS place FROM s)', 'b')}, a AS (SELECT attempt_id, {_REF} AS ref FROM refs), w AS (SELECT attempt_id, ref FROM a WHERE ref IS NOT NULL
UNION SELECT attempt_id, 'table://' || regexp_extract(ref, '^field://(.*)/[^/]+$', 1) FROM a WHERE ref IS NOT NULL UNION SELECT attempt_id, 'table://' || lower(name) FROM rel WHERE NOT is_cte)
SELECT string_split(ref, '://')[1] AS scheme, ref, count(*) AS statements FROM w GROUP BY ALL""")
def asset_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Tables and fields by how many statements use them."""
    s = sqlfacts.statements(table(spark, d, "generation_attempts"), "attempt_id", "sql_text")
    return assets.asset_refs(s).groupBy("scheme", "ref").agg(F.count("*").alias("statements"))


def _claims(rows: str) -> str:
    """The SQL of the projections over ``rows`` (record, sql) under a key of record and text, up to the CTE said."""
    facts = _PROJECTIONS.replace("generation_attempts", f"(SELECT struct_pack(r := record, h := sha256(sql)) AS attempt_id, sql AS sql_text FROM ({rows}) WHERE sql IS NOT NULL)")
    return facts + r""", claims AS (SELECT DISTINCT attempt_id.r AS record, output AS label, lower(regexp_replace(regexp_replace(trim(output), '(?i)^(?:sum|avg|average|max|min|count)[_\-\s]+', ''), '[\s_\-（）()【】\[\]]+', '', 'g')) AS normalized, replace(role, '_candidate', '') AS role,
CASE WHEN role = 'measure_candidate' THEN signature ELSE fields END AS key FROM facts WHERE fields <> '' AND role <> 'wildcard' AND output IS NOT NULL AND NOT regexp_matches(trim(output), '(?i)^(?:LONG_COL_?\d+|COL_?\d+|c\d+|图表\d*|组件\d*)$')),
said AS (SELECT * FROM claims WHERE normalized <> '')"""


@query(f"""{_claims("SELECT node_id AS record, query AS sql FROM nodes")}, n AS (SELECT role, normalized, key, label, count(DISTINCT record) AS n FROM said GROUP BY ALL), l AS (SELECT role, normalized, key, arg_min(label, (-n, label)) AS label FROM n GROUP BY ALL),
g AS (SELECT role, normalized, key, count(DISTINCT record) AS members FROM said GROUP BY ALL HAVING count(DISTINCT record) > 1)
SELECT 'department-concept://' || substr(sha256(role || '|' || normalized || '|' || key), 1, 20) AS concept, role, normalized, label, members FROM g JOIN l USING (role, normalized, key)""")
def merged_concepts(spark: SparkSession, d: str) -> DataFrame:
    return assets.merged_concepts(assets.concept_claims(table(spark, d, "nodes"), "node_id", "query"))


@query(f"""{_claims("SELECT record_id AS record, sql FROM (" + REPORTS["p1_statements"] + ")")}, once AS (SELECT DISTINCT role, normalized, key, record FROM said), n AS (SELECT role, count(*) AS claims FROM once GROUP BY 1),
by_label AS (SELECT role, sum(n * (n - 1) // 2)::BIGINT AS label_pairs FROM (SELECT role, normalized, count(*) AS n FROM once GROUP BY ALL) GROUP BY 1), by_key AS (SELECT role, sum(n * (n - 1) // 2)::BIGINT AS safe_pairs FROM (SELECT role, normalized, key, count(*) AS n FROM once GROUP BY ALL) GROUP BY 1)
SELECT role, claims, claims * (claims - 1) // 2 AS all_pairs, label_pairs, safe_pairs, CASE WHEN claims < 2 THEN 0.0 ELSE round(label_pairs / (claims * (claims - 1) // 2), 6) END AS kept_share FROM n JOIN by_label USING (role) JOIN by_key USING (role)""")
def pair_reduction(spark: SparkSession, d: str) -> DataFrame:
    return assets.pair_reduction(assets.concept_claims(statement_table(_reports(spark, d)), "record_id", "sql"))


@query(f"""{_FACTS}, f AS (SELECT DISTINCT attempt_id, lower(string_split(name, '.')[-1]) AS t FROM rel WHERE NOT is_cte), u AS (SELECT DISTINCT attempt_id, used_tables FROM generation_attempts),
l AS (SELECT attempt_id, lower(string_split(unnest(used_tables), '.')[-1]) AS t FROM u), d AS (SELECT attempt_id, t, count(*) AS n FROM l WHERE t IS NOT NULL GROUP BY ALL)
SELECT attempt_id, t AS table_name, CASE WHEN d.n IS NULL THEN 'out_of_scope' WHEN d.n > 1 THEN 'declared_twice' ELSE 'not_used' END AS finding FROM f FULL JOIN d USING (attempt_id, t) WHERE d.n IS NULL OR d.n > 1 OR f.t IS NULL""")
def scope_findings(spark: SparkSession, d: str) -> DataFrame:
    """Tables, by leaf, that a statement uses undeclared, that are declared twice, or declared and not used."""
    attempts = table(spark, d, "generation_attempts")
    leaf = F.lower(F.substring_index("t", ".", -1))
    used = sqlfacts.alias_map(sqlfacts.statements(attempts, "attempt_id", "sql_text")).filter("NOT is_cte").select(F.col("key").alias("attempt_id"), F.lower(F.substring_index("table_name", ".", -1)).alias("table_name")).distinct().withColumn("used", F.lit(True))
    said = attempts.select("attempt_id", "used_tables").distinct().select("attempt_id", F.explode("used_tables").alias("t")).filter("t IS NOT NULL").groupBy("attempt_id", leaf.alias("table_name")).agg(F.count("*").alias("n"))
    both = used.join(said, ["attempt_id", "table_name"], "full")
    finding = F.when(F.col("n").isNull(), "out_of_scope").when(F.col("n") > 1, "declared_twice").when(F.col("used").isNull(), "not_used")
    return both.select("attempt_id", "table_name", finding.alias("finding")).filter("finding IS NOT NULL")


@query("""WITH a AS (SELECT DISTINCT * FROM generation_attempts), c AS (SELECT DISTINCT call_id FROM query_writer_calls WHERE call_id IS NOT NULL)
SELECT 'unknown_call' AS finding, attempt_id AS item FROM a WHERE call_id IS NULL OR call_id NOT IN (SELECT call_id FROM c) UNION SELECT 'duplicate_attempt', attempt_id FROM a GROUP BY attempt_id HAVING count(*) > 1
UNION SELECT 'not_covered', CAST(call_id AS VARCHAR) FROM c WHERE call_id NOT IN (SELECT call_id FROM a WHERE call_id IS NOT NULL)""")
def batch_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of no known call, attempt ids with several contents, and calls that no attempt covers."""
    a = table(spark, d, "generation_attempts").distinct()
    c = table(spark, d, "query_writer_calls").select("call_id").filter("call_id IS NOT NULL").distinct()
    kind = lambda df, name, item: df.select(F.lit(name).alias("finding"), F.col(item).cast("string").alias("item"))
    unknown = kind(a.join(c, "call_id", "left_anti"), "unknown_call", "attempt_id")
    twice = kind(a.groupBy("attempt_id").count().filter("count > 1"), "duplicate_attempt", "attempt_id")
    return unknown.unionByName(twice).unionByName(kind(c.join(a, "call_id", "left_anti"), "not_covered", "call_id")).distinct()


_INPUTS = ["model_name", "stage", "question", "dialect"]


@query("""WITH c AS (SELECT DISTINCT call_id, called_at, sha256(array_to_string([coalesce('=' || x, '') FOR x IN [model_name, stage, question, dialect]], chr(31))) AS fingerprint, success FROM query_writer_calls),
g AS (SELECT fingerprint, count(*) AS calls, count(*) FILTER (WHERE success) AS completed, min((called_at, call_id)) FILTER (WHERE success) AS f FROM c GROUP BY 1) SELECT fingerprint, calls, completed, struct_extract(f, 2) AS computed_by, CASE WHEN f IS NULL THEN 0 ELSE calls - 1 END::BIGINT AS to_reuse FROM g""")
def invocation_cache(spark: SparkSession, d: str) -> DataFrame:
    """Calls under the fingerprint of all their inputs: the first completed call of each, whose answer the others may reuse."""
    parts = [F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in _INPUTS]
    rows = table(spark, d, "query_writer_calls").select("call_id", "called_at", F.sha2(F.concat_ws("\u001f", *parts), 256).alias("fingerprint"), "success").distinct()
    first = F.min(F.when(F.col("success"), F.struct("called_at", "call_id")))["call_id"]
    g = rows.groupBy("fingerprint").agg(F.count("*").alias("calls"), F.count_if("success").alias("completed"), first.alias("computed_by"))
    return g.withColumn("to_reuse", F.when(F.col("completed") > 0, F.col("calls") - 1).otherwise(F.lit(0).cast("bigint")))


@query("SELECT question, stage, call_id, response FROM (SELECT *, row_number() OVER (PARTITION BY question, stage ORDER BY called_at DESC NULLS LAST, call_id DESC, response DESC) AS rn FROM query_writer_calls WHERE question IS NOT NULL) WHERE rn = 1")
def latest_answers(spark: SparkSession, d: str) -> DataFrame:
    """Upsert by key: of each question and stage the latest answer stands."""
    rows = table(spark, d, "query_writer_calls").filter("question IS NOT NULL").select("question", "stage", "call_id", "response", "called_at")
    return keep_first(rows, ["question", "stage"], [F.col("called_at").desc_nulls_last(), F.col("call_id").desc_nulls_last(), F.col("response").desc_nulls_last()]).drop("called_at")


@query("""WITH n AS (SELECT DISTINCT * FROM nodes), s AS (SELECT node_type, concat_ws(';', CASE WHEN description IS NULL THEN 'description missing' WHEN trim(description) IN ('', 'field comment missing') THEN 'description empty' END, CASE WHEN coalesce(len(table_names), 0) = 0 THEN 'tables missing' END,
CASE WHEN node_type = 'example_query' AND coalesce(trim(query), '') = '' THEN 'query missing' END) AS status FROM n) SELECT node_type, CASE WHEN status = '' THEN 'complete' ELSE status END AS status, count(*) AS nodes FROM s GROUP BY ALL""")
def metadata_status(spark: SparkSession, d: str) -> DataFrame:
    """What the nodes of the catalog lack."""
    bare = F.trim("description")
    status = F.concat_ws(
        ";", F.when(F.col("description").isNull(), "description missing").when(bare.isin("", "field comment missing"), "description empty"), F.when(F.coalesce(F.array_size("table_names"), F.lit(0)) == 0, "tables missing"),
        F.when((F.col("node_type") == "example_query") & (F.coalesce(F.trim("query"), F.lit("")) == ""), "query missing"),
    )
    return table(spark, d, "nodes").distinct().groupBy("node_type", F.when(status == "", "complete").otherwise(status).alias("status")).agg(F.count("*").alias("nodes"))


@query(f"""WITH q AS (SELECT DISTINCT node_id, user_name, query, table_names FROM nodes WHERE node_type = 'example_query'), t AS (SELECT user_name, count(DISTINCT t) AS subjects FROM (SELECT user_name, unnest(table_names) AS t FROM q) WHERE t <> '' GROUP BY 1)
SELECT u.user_name, u.statements, u.texts, coalesce(t.subjects, 0) AS subjects FROM (SELECT user_name, count(*) AS statements, count(DISTINCT sha256(query)) AS texts FROM q GROUP BY 1) u LEFT JOIN t ON t.user_name IS NOT DISTINCT FROM u.user_name""")
def query_log_usage(spark: SparkSession, d: str) -> DataFrame:
    """Users of the query log: statements, different texts, and the tables that they are about."""
    q = table(spark, d, "nodes").filter("node_type = 'example_query'").select("node_id", "user_name", "query", "table_names").distinct()
    subjects = q.select("user_name", F.explode("table_names").alias("t")).filter("t <> ''").groupBy(F.col("user_name").alias("u")).agg(F.count_distinct("t").alias("subjects"))
    g = q.groupBy("user_name").agg(F.count("*").alias("statements"), F.count_distinct(F.sha2("query", 256)).alias("texts"))
    return g.join(subjects, g["user_name"].eqNullSafe(subjects["u"]), "left").select("user_name", "statements", "texts", F.coalesce("subjects", F.lit(0).cast("bigint")).alias("subjects"))
