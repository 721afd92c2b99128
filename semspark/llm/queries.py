"""Queries of the problems tagged llm, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import loose_code
from ..session import table
from .defects import answer_facts, defect_posteriors, one_defect
from .near_duplicates import NearDuplicates
from .packing import pack
from .quantiles import load_summaries, percentiles
from .subjects import MOST, SubjectGraph
from .tokens import count_tokens, encode_texts

CAPACITY = 2048
SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
EPSILON = 0.005


def _statements(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes").select(F.col("node_id").alias("key"), F.col("query").alias("text"))
    return nodes.unionByName(table(spark, d, "generation_attempts").select(F.col("attempt_id").alias("key"), F.col("sql_text").alias("text")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(_statements(spark, d), "key", "text").key_pairs()


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """Each key with the least key of its class of equal multisets, the class's keys and the keys alike to it."""
    return NearDuplicates(_statements(spark, d), "key", "text").members()


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of classes that are alike, by their least keys."""
    return NearDuplicates(_statements(spark, d), "key", "text").class_links()


def _posteriors(spark: SparkSession, d: str) -> DataFrame:
    return defect_posteriors(answer_facts(table(spark, d, "query_writer_calls"), "call_id", "question", "response"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return one_defect(_posteriors(spark, d)).withColumnRenamed("key", "call_id")


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _posteriors(spark, d)
    return rows.select(F.col("key").alias("call_id"), "defect", F.round("posterior", 4).alias("posterior"))


def _amounts(spark: SparkSession, d: str) -> DataFrame:
    """Rows as they came in each load; a row sent twice counts once."""
    o = table(spark, d, "device_orders")
    used = ["order_id", "load_id", "loaded_at", "product_l1", "order_amount", "profit_amount"]
    return o.select(*used, F.xxhash64(*[c for c in o.columns if c not in used]).alias("rest")).distinct().withColumn("product_l1", loose_code(F.col("product_l1")))


def _load_states(spark: SparkSession, d: str) -> DataFrame:
    return load_summaries(_amounts(spark, d), "product_l1", "load_id", ["order_amount", "profit_amount"], EPSILON)


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(_load_states(spark, d), ["group", "measure"], SHARES, EPSILON).withColumnRenamed("group", "product_l1")


def p6_load_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = percentiles(_load_states(spark, d), ["group", "part", "measure"], [0.5, 0.95], EPSILON)
    return out.withColumnsRenamed({"group": "product_l1", "part": "load_id"})


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").distinct()
    return pack(count_tokens(docs, "text"), "doc_id", "n_tokens", CAPACITY)


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("key", "doc_id")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    used = _packed(spark, d).filter("container IS NOT NULL").groupBy("container").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("used"))
    return used.withColumn("free", CAPACITY - F.col("used"))


def _subjects(spark: SparkSession, d: str) -> SubjectGraph:
    areas = sorted(r[0] for r in table(spark, d, "subject_areas").select(F.lower(F.trim("subject"))).distinct().limit(MOST + 1).collect() if r[0])  # one more than allowed raises an error
    return SubjectGraph(table(spark, d, "documents"), table(spark, d, "doc_labels"), areas)


def _subject_shares(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).document_shares()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subject_shares(spark, d).filter("share >= 0.25").select("doc_id", "subject")


def p10_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The labels used, and whether the rest of the collection bears them out."""
    return _subjects(spark, d).seeds()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    shares = _subject_shares(spark, d).filter("share >= 0.25")
    return shares.groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum("share"), 3).alias("weight"))


QUERIES = {f.__name__: f for f in (p4_found, p4_members, p4_classes, p5_found, p5_labels, p6_percentiles, p6_load_percentiles, p8_ids, p9_packing, p9_containers, p10_found, p10_composition, p10_seeds)}
#: Every pair of classes with a word in common, counted in full.
_LIKE = """
WITH raw AS (SELECT node_id AS key, query AS text FROM nodes UNION ALL SELECT attempt_id, sql_text FROM generation_attempts),
texts AS (SELECT DISTINCT key, list_sort(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS words FROM raw WHERE key IS NOT NULL AND text IS NOT NULL),
keys AS (SELECT key, words FROM texts WHERE len(words) > 0),
classes AS (SELECT row_number() OVER (ORDER BY min(key)) AS id, words, min(key) AS class_key, count(*) AS copies, len(words) AS size FROM keys GROUP BY words),
bags AS (SELECT id, size, w, count(*) AS n FROM (SELECT id, size, unnest(words) AS w FROM classes) GROUP BY ALL),
common AS (SELECT a.id AS a, b.id AS b, a.size AS sa, b.size AS sb, sum(least(a.n, b.n)) AS s FROM bags a JOIN bags b ON a.w = b.w AND a.id < b.id AND a.size >= 0.8 * b.size AND b.size >= 0.8 * a.size GROUP BY ALL),
alike AS (SELECT a, b FROM common WHERE s * 10 >= 8 * (sa + sb - s)),
members AS (SELECT k.key, c.id, c.class_key, c.copies FROM keys k JOIN classes c ON k.words = c.words)
"""
SQL: dict[str, str] = {
    "p4_found": _LIKE + """SELECT DISTINCT least(x.key, y.key) AS key_a, greatest(x.key, y.key) AS key_b
FROM (SELECT a, b FROM alike UNION ALL SELECT id, id FROM classes WHERE copies > 1) p JOIN members x ON x.id = p.a JOIN members y ON y.id = p.b WHERE x.key <> y.key""",
    "p4_classes": _LIKE + "SELECT least(x.class_key, y.class_key) AS class_a, greatest(x.class_key, y.class_key) AS class_b FROM alike p JOIN classes x ON x.id = p.a JOIN classes y ON y.id = p.b",
    "p4_members": _LIKE + """, linked AS (SELECT p.a AS id, sum(c.copies)::BIGINT AS n FROM (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike) p JOIN classes c ON c.id = p.b GROUP BY 1)
SELECT m.key, m.class_key, m.copies, coalesce(l.n, 0) + m.copies - 1 AS links FROM members m LEFT JOIN linked l ON l.id = m.id""",
}
