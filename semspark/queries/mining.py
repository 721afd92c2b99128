"""Queries for facts about SQL statements, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sqlfacts
from ..operators.sqlfacts import LIST_END, RESERVED, item_pattern, nested
from ..session import table
from .reference import _BARE

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


_NAME = r'[\w`"]+(?:\s*\.\s*[\w`"]+){0,2}'
_WORDS = "(" + ", ".join(f"'{w}'" for w in RESERVED) + ")"
# statements, their common table expressions and their relations
_FACTS = rf"""WITH q AS (SELECT DISTINCT attempt_id, regexp_replace({_BARE.format("sql_text")}, '''(?:[^'']|'''')*''', '?', 'g') AS b FROM generation_attempts),
s AS (SELECT * FROM q WHERE regexp_matches(b, '(?i)^(?:select|with)\b')),
ctes AS (SELECT DISTINCT attempt_id, b, lower(unnest(regexp_extract_all(b, '(?i)(?:\bwith|,)\s+(\w+)\s+as\s*\(\s*select', 1))) AS cte FROM s),
lists AS (SELECT attempt_id, b, unnest(string_split(regexp_replace(b, '(?i)\b(?:from|join)\b', chr(1), 'g'), chr(1))[2:]) AS l FROM s),
pieces AS (SELECT attempt_id, b, unnest(string_split(regexp_replace(l, '{LIST_END}', ''), ',')) AS p FROM lists),
named AS (SELECT attempt_id, b, regexp_replace(regexp_extract(p, '^\s*({_NAME})', 1), '[`"\s]', '', 'g') AS name, lower(regexp_extract(p, '(?i)^\s*{_NAME}\s+(?:as\s+)?(\w+)', 1)) AS said FROM pieces),
rel AS (SELECT DISTINCT n.attempt_id, n.b, n.name, CASE WHEN said <> '' AND said NOT IN {_WORDS} THEN said ELSE lower(string_split(n.name, '.')[-1]) END AS alias, c.cte IS NOT NULL AS is_cte
  FROM named n LEFT JOIN ctes c ON c.attempt_id = n.attempt_id AND c.b = n.b AND c.cte = lower(n.name) WHERE n.name <> '')"""


def _refs(rows: str, text: str) -> str:
    """SQL of the references in ``text`` of ``rows`` (attempt_id, b, place) and what they resolve to (CTEs raw, found, refs)."""
    return rf"""raw AS (SELECT DISTINCT attempt_id, b, place, lower(unnest(regexp_extract_all(regexp_replace(regexp_replace({text}, '(?i)(?:\bas\s+)?"[^"]*"', ' ', 'g'), '(?i)\b(?:from|join)\s+[\w.`]+|\bas\s+\w+|\b\w+\s*\(', ' ( ', 'g'), '(?i)\b([a-z_]\w*(?:\.[a-z_]\w*){{0,2}})', 1))) AS ref FROM {rows}),
found AS (SELECT *, CASE WHEN contains(ref, '.') THEN regexp_extract(ref, '^(.*)\.[^.]+$', 1) ELSE '' END AS qualifier FROM raw WHERE ref NOT IN {_WORDS}
  AND NOT EXISTS (SELECT 1 FROM rel r WHERE r.attempt_id = raw.attempt_id AND r.b = raw.b AND (r.alias = raw.ref OR lower(r.name) = raw.ref)) AND NOT EXISTS (SELECT 1 FROM ctes c WHERE c.attempt_id = raw.attempt_id AND c.b = raw.b AND c.cte = raw.ref)),
met AS (SELECT f.attempt_id, f.b, f.place, f.ref, f.qualifier, count(DISTINCT lower(r.name)) AS n, min(lower(r.name)) AS name, coalesce(bool_or(r.is_cte), false) AS is_cte FROM found f
  LEFT JOIN rel r ON r.attempt_id = f.attempt_id AND r.b = f.b AND (f.qualifier = '' OR r.alias = f.qualifier OR lower(r.name) = f.qualifier) GROUP BY ALL),
refs AS (SELECT *, CASE WHEN n = 0 THEN CASE WHEN qualifier = '' THEN 'no_table' ELSE 'unknown_alias' END WHEN n > 1 THEN CASE WHEN qualifier = '' THEN 'unqualified_ambiguous' ELSE 'alias_ambiguous' END
  WHEN is_cte THEN 'cte' WHEN qualifier = '' THEN 'sole_table' ELSE 'alias' END AS status FROM met)"""


_REF = "CASE WHEN status IN ('alias', 'sole_table') THEN 'field://' || name || '/' || string_split(ref, '.')[-1] END"


def _statements(spark: SparkSession, d: str) -> DataFrame:
    return sqlfacts.statements(table(spark, d, "generation_attempts"), "attempt_id", "sql_text")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("key", "attempt_id")


@query(f"{_FACTS}\nSELECT attempt_id, alias, name AS table_name, is_cte FROM rel")
def statement_aliases(spark: SparkSession, d: str) -> DataFrame:
    return _named(sqlfacts.alias_map(_statements(spark, d)))


@query(f"{_FACTS},\n{_refs('(SELECT *, 0 AS place FROM s)', 'b')}\nSELECT attempt_id, ref AS reference, CASE WHEN status IN ('alias', 'sole_table') THEN name END AS resolved_table, status, {_REF} AS field_ref FROM refs")
def statement_columns(spark: SparkSession, d: str) -> DataFrame:
    return _named(sqlfacts.column_facts(_statements(spark, d)))


_OUTPUT = r'(?i)\s+as\s+("[^"]*"|`[^`]*`|[^\s,()]+)\s*$'
_PROJECTIONS = rf"""{_FACTS},
outputs AS (SELECT attempt_id, b, regexp_extract_all(regexp_extract(regexp_replace(b, '(?i)^with\s+(?:\w+\s+as\s*{nested(4, "")}\s*,?\s*)+', ''), '(?i)^select\s+(?:distinct\s+)?(.*?)\s+from\b', 1), '{item_pattern("")}') AS items FROM s),
items AS (SELECT attempt_id, b, trim(unnest(items)) AS item, generate_subscripts(items, 1) AS place FROM outputs),
e AS (SELECT *, regexp_replace(item, '{_OUTPUT}', '') AS expr, regexp_replace(regexp_extract(item, '{_OUTPUT}', 1), '["`]', '', 'g') AS named FROM items),
{_refs("e", "expr")},
fields AS (SELECT attempt_id, b, place, string_agg(DISTINCT f, ',' ORDER BY f) AS fields FROM (SELECT attempt_id, b, place, {_REF} AS f FROM refs) WHERE f IS NOT NULL GROUP BY ALL),
aggs AS (SELECT attempt_id, b, place, string_agg(DISTINCT a, ',' ORDER BY a) AS aggregates FROM (SELECT attempt_id, b, place, lower(unnest(regexp_extract_all(expr, '(?i)\b(sum|avg|min|max|count)\s*\(', 1))) AS a FROM e) GROUP BY ALL),
p AS (SELECT attempt_id, place, CASE WHEN named <> '' THEN named WHEN regexp_matches(item, '^[\w.]+$') THEN string_split(item, '.')[-1] END AS output, coalesce(aggregates, '') AS aggregates, regexp_matches(expr, '(?i)\bover\s*\(') AS windowed, coalesce(fields, '') AS fields,
  CASE WHEN regexp_matches(expr, '^(?:\w+\.)?\*$') THEN 'wildcard' WHEN aggregates IS NOT NULL OR regexp_matches(expr, '(?i)\bover\s*\(') THEN 'measure_candidate' ELSE 'dimension_candidate' END AS role
  FROM e LEFT JOIN fields USING (attempt_id, b, place) LEFT JOIN aggs USING (attempt_id, b, place)),
facts AS (SELECT attempt_id, place::INTEGER AS place, output, role, aggregates, windowed, fields, substr(sha256(role || '|' || aggregates || '|' || fields), 1, 20) AS signature FROM p)"""


@query(f"{_PROJECTIONS}\nSELECT * FROM facts")
def statement_projections(spark: SparkSession, d: str) -> DataFrame:
    return _named(sqlfacts.projection_facts(_statements(spark, d)))


@query(f"{_PROJECTIONS}\nSELECT role, signature, count(*) AS projections, count(DISTINCT attempt_id) AS statements, count(DISTINCT output) AS names FROM facts WHERE fields <> '' GROUP BY ALL HAVING count(DISTINCT attempt_id) > 1")
def shared_implementations(spark: SparkSession, d: str) -> DataFrame:
    """Projections of several statements that mean the same role, aggregates and fields, whatever they are called."""
    rows = sqlfacts.projection_facts(_statements(spark, d)).filter("fields <> ''")
    g = rows.groupBy("role", "signature").agg(F.count("*").alias("projections"), F.count_distinct("key").alias("statements"), F.count_distinct("output").alias("names"))
    return g.filter("statements > 1")


@query(rf"""{_FACTS}, m AS (SELECT attempt_id, string_split(regexp_replace(b, '(?i)\b((?:(?:left|right|full|cross|inner)\s+(?:outer\s+)?)?join)\b', chr(1) || '\1', 'g'), chr(1)) AS l FROM s),
j AS (SELECT attempt_id, generate_subscripts(l, 1) - 1 AS place, regexp_replace(unnest(l), '(?i)\s(?:where|group\s+by|order\s+by|having|limit|union)\b.*$', '') AS p FROM m)
SELECT attempt_id, place::INTEGER AS place, coalesce(nullif(lower(regexp_extract(p, '(?i)^(left|right|full|cross|inner)\b', 1)), ''), 'inner') AS kind, nullif(regexp_replace(regexp_extract(p, '(?i)\bjoin\s+({_NAME})', 1), '[`"\s]', '', 'g'), '') AS target,
nullif(trim(regexp_extract(p, '(?i)\bon\s+(.*)$', 1)), '') AS condition, nullif(trim(regexp_extract(p, '(?i)\busing\s*\(([^)]*)\)', 1)), '') AS using_columns FROM j WHERE place > 0""")
def statement_joins(spark: SparkSession, d: str) -> DataFrame:
    return _named(sqlfacts.join_facts(_statements(spark, d)))


def _clause(start: str, stops: str, text: str = "b") -> str:
    return rf"regexp_extract({text}, '(?i)\b{start}\b\s*(.*?)\s*(?:\b(?:{stops})\b|$)', 1)"


_OUTER = f"regexp_replace(b, '{nested(4, '')}', '()', 'g')"


@query(rf"""{_FACTS} SELECT attempt_id, nullif({_clause("where", r"group\s+by|order\s+by|having|limit")}, '') AS where_text, len(regexp_extract_all({_clause(r"group\s+by", r"order\s+by|having|limit", _OUTER)}, '{item_pattern("")}'))::INTEGER AS group_by,
len(regexp_extract_all({_clause(r"order\s+by", "limit", _OUTER)}, '{item_pattern("")}'))::INTEGER AS order_by, len(regexp_extract_all(b, '\?'))::INTEGER AS placeholders, len(regexp_extract_all(b, '(?:^|[\s(,=<>])(\d+(?:\.\d+)?)\b'))::INTEGER AS numbers FROM s""")
def statement_clauses(spark: SparkSession, d: str) -> DataFrame:
    return _named(sqlfacts.clause_facts(_statements(spark, d)))


@query(rf"""{_FACTS}, c AS (SELECT attempt_id, trim(replace(unnest(string_split_regex(regexp_replace({_clause("where", r"group\s+by|order\s+by|having|limit")}, '(?i)(\bbetween\s+\S+)\s+and\s+', '\1 ' || chr(1) || ' ', 'g'), '(?i)\s+and\s+')), chr(1), 'and')) AS conjunct FROM s)
SELECT DISTINCT attempt_id, conjunct FROM c WHERE conjunct <> '' AND NOT (regexp_matches(conjunct, '^\(*\s*\d+\s*=\s*\d+\s*\)*$') AND regexp_extract(conjunct, '(\d+)\s*=', 1) = regexp_extract(conjunct, '=\s*(\d+)', 1))""")
def statement_conjuncts(spark: SparkSession, d: str) -> DataFrame:
    return _named(sqlfacts.conjuncts(_statements(spark, d)))


@query(f"{_FACTS},\n{_refs('(SELECT *, 0 AS place FROM s)', 'b')}, g AS (SELECT attempt_id, name AS table_name, string_agg(DISTINCT string_split(ref, '.')[-1], ', ' ORDER BY string_split(ref, '.')[-1]) AS columns FROM refs WHERE status IN ('alias', 'sole_table') GROUP BY ALL)\nSELECT *, 'SELECT ' || columns || ' FROM ' || table_name AS reads FROM g")
def dry_plans(spark: SparkSession, d: str) -> DataFrame:
    return _named(sqlfacts.needed_columns(_statements(spark, d)))


@query(f"""{_FACTS}, u AS (SELECT DISTINCT attempt_id, lower(unnest(used_tables)) AS t FROM generation_attempts), said AS (SELECT attempt_id, t FROM u WHERE t IS NOT NULL),
f AS (SELECT DISTINCT attempt_id, lower(name) AS t FROM rel WHERE NOT is_cte), e AS (SELECT attempt_id, count(t) AS found, count(*) FILTER (WHERE (attempt_id, t) IN (SELECT (attempt_id, t) FROM said)) AS agreed FROM (SELECT DISTINCT attempt_id FROM s) LEFT JOIN f USING (attempt_id) GROUP BY 1),
l AS (SELECT attempt_id, count(DISTINCT string_split(t, '.')[-1]) AS leaves FROM f WHERE (attempt_id, string_split(t, '.')[-1]) IN (SELECT (attempt_id, string_split(t, '.')[-1]) FROM said) GROUP BY 1)
SELECT (SELECT count(DISTINCT attempt_id) FROM generation_attempts) AS attempts, count(*) AS parsed, sum(found)::BIGINT AS tables_found, sum(agreed)::BIGINT AS tables_declared, sum(coalesce(leaves, 0))::BIGINT AS leaves_declared, count(*) FILTER (WHERE found = agreed) AS statements_in_full FROM e LEFT JOIN l USING (attempt_id)""")
def extraction_summary(spark: SparkSession, d: str) -> DataFrame:
    """How far the facts reach: statements with facts, and the tables found that the writer declares too, in full and by leaf."""
    attempts = table(spark, d, "generation_attempts")
    said = attempts.select(F.col("attempt_id").alias("key"), F.explode("used_tables").alias("t")).filter("t IS NOT NULL").groupBy("key").agg(F.collect_set(F.lower("t")).alias("said"))
    found = F.array_distinct(F.transform(F.filter("relations", lambda r: ~r["cte"]), lambda r: F.lower(r["name"])))
    rows = _statements(spark, d).select("key", F.explode_outer(found).alias("t")).groupBy("key").agg(F.collect_set("t").alias("found"))
    leaf = lambda a: F.array_distinct(F.transform(a, lambda t: F.substring_index(t, ".", -1)))
    none = F.array().cast("array<string>")
    rows = rows.join(said, "key", "left").withColumn("said", F.coalesce("said", none))
    rows = rows.select(F.size("found").alias("found"), F.size(F.array_intersect("found", "said")).alias("agreed"), F.size(F.array_intersect(leaf("found"), leaf("said"))).alias("leaves"))
    total = attempts.agg(F.count_distinct("attempt_id").alias("attempts"))  # one row
    g = rows.agg(F.count("*").alias("parsed"), F.sum("found").alias("tables_found"), F.sum("agreed").alias("tables_declared"), F.sum("leaves").alias("leaves_declared"), F.count_if(F.col("found") == F.col("agreed")).alias("statements_in_full"))
    return total.join(F.broadcast(g), F.lit(True))


_DANGER = r"(?i)\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke)\s"


@query(rf"""WITH q AS (SELECT DISTINCT attempt_id, sql_text, {_BARE.format("sql_text")} AS bare FROM generation_attempts), b AS (SELECT attempt_id, regexp_replace(bare, '''(?:[^'']|'''')*''', '?', 'g') AS b FROM q)
SELECT attempt_id, coalesce(NOT regexp_matches(b, '(?i)^(?:select|with)\b'), true) AS not_a_query, coalesce(regexp_matches(b, ';\s*\S'), false) AS several_statements, coalesce(regexp_matches(b, '{_DANGER}'), false) AS changes_data,
coalesce(NOT regexp_matches({_clause("where", r"group\s+by|order\s+by|having|limit")}, '(?i)(?:^|\W)org_code\s*(?:=\s*(?:\?|\d)|in\s*\([^)]*(?:\?|\d))'), true) AS no_organisation FROM b""")
def statement_guard(spark: SparkSession, d: str) -> DataFrame:
    """Each attempt with the rules that it breaks; an attempt without a text breaks the first and the last."""
    rows = table(spark, d, "generation_attempts").select("attempt_id", "sql_text").distinct()
    rows = rows.withColumn("b", F.regexp_replace(sqlfacts.bare(F.col("sql_text")), r"'(?:[^']|'')*'", "?"))
    has = lambda c, p, default: F.coalesce(c.rlike(p), F.lit(default))
    org = has(sqlfacts.where_text(F.col("b")), r"(?i)(?:^|\W)org_code\s*(?:=\s*(?:\?|\d)|in\s*\([^)]*(?:\?|\d))", False)
    b = F.col("b")
    return rows.select("attempt_id", (~has(b, r"(?i)^(?:select|with)\b", False)).alias("not_a_query"), has(b, r";\s*\S", False).alias("several_statements"), has(b, _DANGER, False).alias("changes_data"), (~org).alias("no_organisation")).distinct()
