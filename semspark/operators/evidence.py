"""Evidence about reports and claims about what their columns mean, made from the flat report tables.

Every kind of evidence is one select; the kinds are united, equal items of a report count once, and items are
numbered per report. Claims are the output columns of the reports' statements; alignment compares classes of equal
claims, so a label that every report uses gives one class, not a pair for any two reports.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sqltext
from ..functions.text import char_jaccard, is_generic_label, normalize_label
from ..session import materialise
from .nested import ReportTables, component_table, entity, statement_table

# Kinds that are read from SQL or lineage, and kinds that only place a report.
DETERMINISTIC = ["sql_projection", "sql_table_reference", "sql_filter", "sql_group_by", "field_lineage", "physical_field_comment"]
STRONG = ["sql_filter", "field_lineage", "physical_field_comment"]
COMMON_TABLE = r"(?i)(?:calendar|date_dim|dim_date|dim_org|permission|权限|日历|组织)"
PLACING = ["report_path", "report_mapping", "component_name", "dataset_path"]


def evidence_items(t: ReportTables) -> DataFrame:
    """(record_id, kind, text): each item of a record once."""
    statements = materialise(statement_table(t).filter("sql IS NOT NULL"), "statement_table")  # read by six of the kinds
    components = materialise(component_table(t), "component_table")
    sql = F.col("sql")

    def kind(df: DataFrame, name: str, text: Column) -> DataFrame:
        return df.select("record_id", F.lit(name).alias("kind"), text.cast("string").alias("text"))

    reports = entity(t.reports(), t.nodes, t.KEYS, ["report_path"])
    mapping = t.nodes.filter((F.col("label") == "mapping") & (F.col("kind") == "object")).select(*t.KEYS, "node")
    parts = [
        kind(reports, "report_path", F.col("report_path")),
        kind(t.segments(), "report_path_segment", F.col("segment")),
        kind(entity(mapping, t.nodes, t.KEYS, ["cn_name"]), "report_mapping", F.col("cn_name")),
        kind(components, "component_name", F.col("component_name")),
        kind(components, "dataset_path", F.col("dataset_path")),
        kind(statements, "sql_query", F.sha2(sql, 256)),
        kind(statements.filter(~sqltext.is_query(sql)), "sql_parse_issue", sql),
        kind(statements.withColumn("x", F.explode(sqltext.tables(sql))), "sql_table_reference", F.col("x")),
        kind(statements.withColumn("x", F.explode(sqltext.aliases(sql))), "sql_projection", F.col("x")),
        kind(statements, "sql_filter", sqltext.where_text(sql)),
        kind(statements, "sql_group_by", sqltext.group_text(sql)),
        kind(t.physical_tables(), "physical_table", F.col("table_name")),
    ]
    return reduce(DataFrame.unionByName, parts).filter(F.col("text").rlike(r"(?U)\S")).distinct()


def numbered(items: DataFrame) -> DataFrame:
    """``items`` with evidence_no (E001, ...) by kind and text within a record."""
    w = W.partitionBy("record_id").orderBy("kind", "text")
    return items.withColumn("evidence_no", F.format_string("E%03d", F.row_number().over(w)))


def grade(kinds: Column) -> Column:
    """A: a projection with lineage or comments. B: SQL evidence beside other evidence. C: placing evidence only. U: none."""
    holds = lambda names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(F.array_contains(kinds, "sql_projection") & holds(["physical_field_comment", "field_lineage"]), "A")
        .when(holds(DETERMINISTIC) & ((F.size(kinds) >= 2) | holds(STRONG)), "B")
        .when(holds([*DETERMINISTIC, *PLACING]), "C")
        .otherwise("U")
    )


def packages(items: DataFrame, budget: int = 120_000) -> DataFrame:
    """(record_id, kinds, items, chars, grade, status): a package above ``budget`` characters must be cut by component."""
    p = items.groupBy("record_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("items"), F.sum(F.length("text")).alias("chars"))
    status = F.when(F.col("chars") <= budget, "ready").otherwise("requires_component_cluster_chunking")
    return p.withColumns({"grade": grade(F.col("kinds")), "status": status})


PROJECTION = r"""regexp_extract_all(sql, '(?i)(?:select|,)\\s*((?:\\w+\\s*\\(\\s*(?:distinct\\s+)?[\\w.*]+\\s*\\))|[\\w.]+)\\s+as\\s+"([^"]+)"', 0)"""


def _claim(piece: Column) -> list[Column]:
    label = F.regexp_extract(piece, r'"([^"]+)"', 1)
    made = F.lower(F.regexp_replace(F.regexp_extract(piece, r'(?is)^(?:select|,)\s*(.*?)\s+as\s+"', 1), r"\s+", ""))
    return [label.alias("label"), normalize_label(label).alias("normalized"), made.alias("implementation")]


def projection_claims(t: ReportTables) -> DataFrame:
    """(record_id, label, normalized, implementation): each quoted output column with the expression that makes it."""
    rows = statement_table(t).filter("sql IS NOT NULL").select("record_id", F.explode(F.expr(PROJECTION)).alias("piece"))
    return rows.select("record_id", *_claim(F.col("piece")))


def audit_labels(claims: DataFrame) -> DataFrame:
    """(normalized, observations, implementations, verdict): generic, ambiguous (several implementations), consistent or single."""
    g = claims.withColumn("generic", is_generic_label(F.col("label"))).groupBy("normalized").agg(F.count("*").alias("observations"), F.count_distinct("implementation").alias("implementations"), F.bool_or("generic").alias("generic"))
    verdict = F.when(F.col("generic"), "generic").when(F.col("implementations") > 1, "ambiguous").when(F.col("observations") > 1, "consistent").otherwise("single")
    return g.withColumn("verdict", verdict).drop("generic")


def synonym_candidates(claims: DataFrame) -> DataFrame:
    """(implementation, labels): implementations that go under several labels."""
    named = claims.filter(~is_generic_label(F.col("label")))
    return named.groupBy("implementation").agg(F.array_sort(F.collect_set("normalized")).alias("labels")).filter(F.size("labels") > 1)


def claims_in_context(t: ReportTables) -> DataFrame:
    """projection_claims with the physical field (small letters, without alias), the dataset and the tables of each claim."""
    rows = statement_table(t).filter("sql IS NOT NULL").select("record_id", "component_no", F.explode(F.expr(PROJECTION)).alias("piece"), sqltext.tables(F.col("sql")).alias("tables"))
    data = component_table(t).filter("dataset_path IS NOT NULL").select("record_id", "component_no", F.col("dataset_path").alias("dataset")).distinct()
    field = F.lower(F.regexp_extract("piece", r'(?i)(\w+)\s*\)?\s+as\s+"', 1))
    rows = rows.join(data, ["record_id", "component_no"], "left")
    return rows.select("record_id", *_claim(F.col("piece")), F.when(field != "", field).alias("field"), "dataset", "tables")


def align_classes(claims: DataFrame, threshold: float = 4.0) -> DataFrame:
    """(left_label, left_implementation, right_label, right_implementation, signals, score): classes of claims that may mean the same.

    A class is a label with an implementation; equal claims are one class already. Classes are scored where they share
    label (5), field (4), implementation (5), or a dataset (1.5) under labels that share half of their characters (2):
    without one of the first three, only both of these and a table in common (at least 0.2, at most 1: the mean share of
    reports without the table) can reach the threshold. Classes that stand in one and the same report only never pair.
    """
    said = materialise(claims.filter(~is_generic_label(F.col("label"))), "claims")
    tables = said.select("record_id", F.explode("tables").alias("table")).distinct()
    reports = said.select("record_id").distinct().agg(F.count("*").alias("reports"))
    weights = tables.filter(~F.col("table").rlike(COMMON_TABLE)).groupBy("table").agg(F.count("*").alias("n")).join(F.broadcast(reports)).select("table", (1 - F.col("n") / F.col("reports")).alias("weight"))
    keys = ["normalized", "implementation"]
    own = said.select(*keys, F.explode("tables").alias("table")).distinct().join(weights, "table")
    own = own.groupBy(*keys).agg(F.collect_set(F.concat_ws("\t", F.col("weight").cast("string"), "table")).alias("tables"))
    classes = said.groupBy(*keys).agg(F.min("field").alias("field"), F.collect_set("dataset").alias("datasets"), F.min("record_id").alias("first"), F.max("record_id").alias("last"))
    classes = materialise(classes.join(own, keys, "left").withColumn("key", F.concat_ws("\t", *keys)), "classes")

    def block(on: DataFrame) -> DataFrame:
        """Keys of the pairs that share ``by``."""
        a, b = on.select("by", F.col("key").alias("a"), F.col("normalized").alias("la")), on.select("by", F.col("key").alias("b"), F.col("normalized").alias("lb"))
        return a.join(b, "by").filter("a < b")

    alike = char_jaccard(F.col("la"), F.col("lb")) >= 0.5
    parts = [block(classes.withColumn("by", F.col(c)).filter("by IS NOT NULL")) for c in ("normalized", "field", "implementation")]
    parts.append(block(classes.withColumn("by", F.explode("datasets"))).filter("la <> lb").filter(alike))
    pairs = reduce(DataFrame.unionByName, [p.select("a", "b") for p in parts]).distinct()
    left, right = (classes.select(*[F.col(c).alias(f"{x}_{c}") for c in classes.columns]) for x in "lr")
    met = pairs.join(left, F.col("a") == F.col("l_key")).join(right, F.col("b") == F.col("r_key"))
    met = met.filter("NOT (l_first = l_last AND r_first = r_last AND l_first = r_first)")
    same = lambda c: F.coalesce(F.col(f"l_{c}") == F.col(f"r_{c}"), F.lit(False))
    none = F.array().cast("array<string>")
    shared = F.transform(F.array_intersect(F.coalesce("l_tables", none), F.coalesce("r_tables", none)), lambda x: F.substring_index(x, "\t", 1).cast("double"))
    mean = F.aggregate(shared, F.lit(0.0), lambda s, x: s + x) / F.size(shared)
    signals = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(n).alias("name"), w.alias("weight"))) for n, test, w in (
        ("exact_normalized_label", same("normalized"), F.lit(5.0)),
        ("character_overlap", ~same("normalized") & (char_jaccard(F.col("l_normalized"), F.col("r_normalized")) >= 0.5), F.lit(2.0)),
        ("shared_physical_field", same("field"), F.lit(4.0)),
        ("same_implementation_signature", same("implementation") & (F.col("l_implementation") != ""), F.lit(5.0)),
        ("shared_dataset", F.arrays_overlap("l_datasets", "r_datasets"), F.lit(1.5)),
        ("shared_business_table_idf", F.size(shared) > 0, F.round(F.greatest(F.lit(0.2), F.when(F.size(shared) > 0, mean)), 4)),
    )]))
    met = met.withColumn("found", signals).withColumn("score", F.round(F.aggregate("found", F.lit(0.0), lambda s, x: s + x["weight"]), 4))
    return met.filter(F.col("score") >= threshold).select(
        F.col("l_normalized").alias("left_label"), F.col("l_implementation").alias("left_implementation"), F.col("r_normalized").alias("right_label"), F.col("r_implementation").alias("right_implementation"),
        F.col("found.name").alias("signals"), "score",
    )
