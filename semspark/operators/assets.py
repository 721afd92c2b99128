"""Reports as assets: what is wrong with them, what they map to, what their statements use, and concepts that reports share.

Defined results: nulls and blanks count as missing, repeated rows count once, empty tables give no rows. Groups are
pre-aggregated before the shuffle and give counts, never lists of their members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import empty_segment_places, is_generic_label, normalize_label, path_segments, text_or_null
from ..session import materialise
from . import sqlfacts
from .nested import ReportTables, component_table, entity, report_table, statement_table

RECORD = ["record_id", "report_id", "exported_at", "copy_no"]


def title_key(title: Column) -> Column:
    """A title without label noise and without the number at its end."""
    return F.regexp_replace(normalize_label(title), r"\d+$", "")


def lookup_titles(titles: DataFrame, title: str, names: DataFrame, name: str) -> DataFrame:
    """``titles`` with mapped and found_by: exact, without_period (a leading 【yyyymm】 taken off), normalized (if one name has it) or none."""
    known = names.select(F.col(name).alias("_name")).filter(text_or_null(F.col(name)).isNotNull()).distinct()
    keyed = known.groupBy(title_key(F.col("_name")).alias("_key")).agg(F.count("*").alias("_n"), F.min("_name").alias("_one")).filter("_n = 1 AND _key <> ''")
    bare = F.regexp_replace(F.col(title), r"^【\d{6}】", "")
    out = titles.withColumns({"_bare": bare, "_key": title_key(bare)})
    out = out.join(known.withColumn("_exact", F.col("_name")), F.col(title) == F.col("_name"), "left").drop("_name")
    out = out.join(known.withColumn("_cut", F.col("_name")), F.col("_bare") == F.col("_name"), "left").drop("_name").join(keyed, "_key", "left")
    by = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_cut").isNotNull(), "without_period").when(F.col("_one").isNotNull(), "normalized").otherwise("none")
    return out.withColumns({"mapped": F.coalesce("_exact", "_cut", "_one"), "found_by": by}).drop("_bare", "_key", "_exact", "_cut", "_n", "_one")


def mapping_names(t: ReportTables) -> DataFrame:
    """(cn_name): the names in the reports' own mappings, each once."""
    mapping = t.nodes.filter((F.col("label") == "mapping") & (F.col("kind") == "object")).select(*t.KEYS, F.col("parent").alias("owner"), "node")
    own = mapping.join(t.reports().withColumnRenamed("node", "owner"), [*t.KEYS, "owner"]).drop("owner")
    return entity(own, t.nodes, t.KEYS, ["cn_name"]).select("cn_name").distinct()


def report_assets(t: ReportTables) -> DataFrame:
    """A row per report: its record, path, title, mapped, found_by, identity_status, issues.

    identity_status is source_mapped (a name is found for the title), provisional_path or provisional_missing. issues
    joins missing_report_path, report_path_empty_segment and dataset_path_empty_segment (of any component) by commas.
    """
    empty = lambda c: F.size(empty_segment_places(F.col(c))) > 0
    bad = entity(t.datasets(), t.nodes, t.KEYS, ["dataset_path"]).filter(empty("dataset_path")).groupBy(*t.KEYS).agg(F.count("*").alias("bad"))
    rows = entity(t.reports(), t.nodes, t.KEYS, ["report_path"]).join(bad, t.KEYS, "left").withColumn("path", text_or_null(F.col("report_path")))
    rows = rows.withColumn("title", F.try_element_at(path_segments(F.col("path")), F.lit(-1)))
    rows = lookup_titles(rows, "title", mapping_names(t), "cn_name")
    issues = F.concat_ws(",", F.when(F.col("path").isNull(), "missing_report_path"), F.when(empty("path"), "report_path_empty_segment"), F.when(F.col("bad") > 0, "dataset_path_empty_segment"))
    status = F.when(F.col("mapped").isNotNull(), "source_mapped").when(F.col("path").isNotNull(), "provisional_path").otherwise("provisional_missing")
    return t.table(rows, "path", "title", "mapped", "found_by", status.alias("identity_status"), issues.alias("issues"))


def name_anomalies(t: ReportTables) -> DataFrame:
    """(record, component_name, components, datasets): names that components on several datasets of a report share."""
    g = component_table(t).filter(text_or_null(F.col("component_name")).isNotNull()).groupBy(*RECORD, "component_name")
    return g.agg(F.count("*").alias("components"), F.count_distinct("dataset_path").alias("datasets")).filter("datasets > 1")


def statement_groups(t: ReportTables) -> DataFrame:
    """(record, component_no, fingerprint, statements, occurrences, places): equal texts of a component, with their sorted places."""
    rows = statement_table(t).filter("sql IS NOT NULL").groupBy(*RECORD, "component_no", F.sha2("sql", 256).alias("fingerprint"))
    places = F.array_join(F.array_sort(F.collect_set("statement_no")).cast("array<string>"), ",")  # a component's own, not a group of records
    return rows.agg(F.count("*").alias("statements"), F.sum(F.coalesce("occurrence_count", F.lit(1))).alias("occurrences"), places.alias("places"))


def asset_summary(t: ReportTables) -> DataFrame:
    """(asset, status, assets, unnamed): counters of reports, components and statements by status."""
    missing = lambda c: F.count_if(text_or_null(F.col(c)).isNull()).alias("unnamed")
    parts = [("report", report_table(t), F.col("status"), "report_path"), ("component", component_table(t), F.col("dataset_status"), "component_name"), ("statement", statement_table(t), F.lit(None).cast("string"), "sql")]
    frames = [df.groupBy(s.alias("status")).agg(F.count("*").alias("assets"), missing(c)).select(F.lit(n).alias("asset"), "status", "assets", "unnamed") for n, df, s, c in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def asset_refs(s: DataFrame) -> DataFrame:
    """(key, scheme, ref): tables and fields of ``sqlfacts.statements``; a field implies its table."""
    fields = sqlfacts.column_facts(s).filter("field_ref IS NOT NULL").select("key", F.col("field_ref").alias("ref"))
    implied = fields.select("key", F.regexp_replace(F.regexp_extract("ref", r"^(field://.*)/[^/]+$", 1), "^field", "table").alias("ref"))
    named = sqlfacts.alias_map(s).filter("NOT is_cte").select("key", F.concat(F.lit("table://"), F.lower("table_name")).alias("ref"))
    rows = fields.unionByName(implied).unionByName(named).distinct()
    return rows.select("key", F.substring_index("ref", "://", 1).alias("scheme"), "ref")


def concept_claims(texts: DataFrame, record: str, sql: str) -> DataFrame:
    """(record, label, normalized, role, key): outputs of the records' statements that resolve.

    key is the implementation signature of a measure and the field of a dimension. Each rests on SQL evidence of two
    kinds, projection and table, so its grade is B at least; generic labels say nothing and are left out.
    """
    rows = texts.filter(F.col(sql).isNotNull()).select(F.struct(F.col(record).alias("record"), F.sha2(F.col(sql), 256)).alias("at"), F.col(sql).alias("sql"))
    facts = sqlfacts.projection_facts(sqlfacts.statements(rows, "at", "sql")).filter("fields <> '' AND role <> 'wildcard' AND output IS NOT NULL")
    label, key = F.col("output"), F.when(F.col("role") == "measure_candidate", F.col("signature")).otherwise(F.col("fields"))
    said = facts.filter(~is_generic_label(label)).select(F.col("key.record").alias("record"), label.alias("label"), normalize_label(label).alias("normalized"), F.replace("role", F.lit("_candidate"), F.lit("")).alias("role"), key.alias("key"))
    return said.filter("normalized <> ''").distinct()


def merged_concepts(claims: DataFrame) -> DataFrame:
    """(concept, role, normalized, label, members): claims of two records or more that are safe to merge.

    Safe is: one role, one normalised label, and one implementation (measures) or field (dimensions). These are equalities,
    so the classes are groups and no pair is made. label is the most frequent one, of equal ones the least; the
    reference hashes the class, as its members may be any number.
    """
    counted = claims.groupBy("role", "normalized", "key", "label").agg(F.count_distinct("record").alias("n"))
    label = F.min(F.struct((-F.col("n")).alias("c"), "label"))["label"]
    g = counted.groupBy("role", "normalized", "key").agg(label.alias("label"))
    size = claims.select("role", "normalized", "key", "record").distinct().groupBy("role", "normalized", "key").agg(F.count("*").alias("members")).filter("members > 1")
    ref = F.concat(F.lit("department-concept://"), F.substring(F.sha2(F.concat_ws("|", "role", "normalized", "key"), 256), 1, 20))
    return size.join(g, ["role", "normalized", "key"]).select(ref.alias("concept"), "role", "normalized", "label", "members")


def pair_reduction(claims: DataFrame) -> DataFrame:
    """(role, claims, all_pairs, label_pairs, safe_pairs, kept_share): how far blocking cuts the pairs, counted and never made.

    kept_share is label_pairs by all_pairs, to 6 places, 0 where there is no pair.
    """
    c = materialise(claims.select("role", "normalized", "key", "record").distinct(), "claims")
    pairs = lambda n: (F.col(n).cast("decimal(38,0)") * (F.col(n) - 1) / 2).cast("decimal(38,0)")
    safe = c.groupBy("role", "normalized", "key").agg(F.count("*").alias("n")).withColumn("safe", pairs("n"))
    label = safe.groupBy("role", "normalized").agg(F.sum("n").alias("n"), F.sum("safe").alias("safe")).withColumn("label", pairs("n"))
    g = label.groupBy("role").agg(F.sum("n").alias("claims"), F.sum("label").cast("bigint").alias("label_pairs"), F.sum("safe").cast("bigint").alias("safe_pairs"))
    g = g.withColumn("all_pairs", pairs("claims").cast("bigint"))
    return g.withColumn("kept_share", F.round(F.coalesce(F.try_divide(F.col("label_pairs").cast("double"), F.col("all_pairs").cast("double")), F.lit(0.0)), 6))
