"""Facts about SQL statements as rows: relations, columns, projections, joins, conjuncts.

Each function takes (key, sql) rows and works inside a row; the only shuffle is the one that leaves out repeated rows.
Patterns over text, no parser: a select list ends at the first FROM, parentheses count to a depth of four, quoted names
are output names. Null, blank and other texts than SELECT and WITH give no facts; a statement that comes several times
counts once; columns beside key and sql are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import AGGREGATES, NAME, bare, clause, cte_names, where_text

# Words that are no column and no alias.
RESERVED = (
    "all and any as asc between by case cast cross date desc distinct else end except exists false first following from full group having if in inner "
    "intersect interval is join last left like limit not null nulls offset on or order outer over partition preceding right row rows select then "
    "timestamp true unbounded union using when where with"
).split()


# what ends the list of relations after FROM or JOIN
LIST_END = r"(?i)\b(?:on|using|where|group|order|having|limit|union|intersect|except|left|right|full|cross|inner)\b.*$|\).*$"


def nested(depth: int, possessive: str = "+") -> str:
    """Pattern of a pair of parentheses with pairs inside, ``depth`` deep."""
    inner = r"\([^()]*\)"
    for _ in range(depth - 1):
        inner = rf"\((?:[^()]+{possessive}|{inner})*\)"
    return inner


def item_pattern(possessive: str = "+") -> str:
    """Pattern of one item of a list: what stands between commas outside parentheses and quotes."""
    return rf'(?:[^,()"]+{possessive}|"[^"]*"|{nested(4, possessive)})+'


OUTPUT = r'(?i)\s+as\s+("[^"]*"|`[^`]*`|[^\s,()]+)\s*$'


def statements(df: DataFrame, key: str, sql: str) -> DataFrame:
    """(key, b, relations): each query once, without comments and string literals, with its relations (alias, name, cte)."""
    rows = df.select(F.col(key).alias("key"), F.regexp_replace(bare(F.col(sql)), r"'(?:[^']|'')*'", "?").alias("b")).filter(r"b RLIKE '(?i)^(?:select|with)\\b'").distinct()
    pieces = F.filter(F.split(F.regexp_replace("b", r"(?i)\b(?:from|join)\b", "\u0001"), "\u0001"), lambda x, i: i > 0)
    pieces = F.flatten(F.transform(pieces, lambda p: F.split(F.regexp_replace(p, LIST_END, ""), ",")))  # FROM a, b names two

    def relation(p: Column) -> Column:
        name = F.regexp_replace(F.regexp_extract(p, rf"^\s*({NAME})", 1), r"[`\"\s]", "")
        said = F.lower(F.regexp_extract(p, rf"(?i)^\s*{NAME}\s+(?:as\s+)?(\w+)", 1))
        alias = F.when((said != "") & ~said.isin(*RESERVED), said).otherwise(F.lower(F.substring_index(name, ".", -1)))
        return F.struct(alias.alias("alias"), name.alias("name"), F.array_contains("ctes", F.lower(name)).alias("cte"))

    rows = rows.withColumn("ctes", cte_names(F.col("b")))
    return rows.select("key", "b", "ctes", F.array_distinct(F.filter(F.transform(pieces, relation), lambda r: r["name"] != "")).alias("relations"))


def references(text: Column, relations: Column, ctes: Column) -> Column:
    """Distinct column references of a text in small letters: names that are no keyword, function, table, alias or output name."""
    t = F.regexp_replace(text, r'(?i)(?:\bas\s+)?"[^"]*"', " ")
    t = F.regexp_replace(t, r"(?i)\b(?:from|join)\s+[\w.`]+|\bas\s+\w+|\b\w+\s*\(", " ( ")
    found = F.transform(F.regexp_extract_all(t, F.lit(r"(?i)\b([a-z_]\w*(?:\.[a-z_]\w*){0,2})"), 1), lambda x: F.lower(x))
    taken = F.concat(F.transform(relations, lambda r: r["alias"]), F.transform(relations, lambda r: F.lower(r["name"])), ctes, F.array(*[F.lit(w) for w in RESERVED]))
    return F.filter(F.array_distinct(found), lambda x: ~F.array_contains(taken, x))


def resolve(ref: Column, relations: Column) -> Column:
    """Struct (reference, resolved_table, status): through its alias, or through the only relation of the statement."""
    qualifier = F.regexp_extract(ref, r"^(.*)\.[^.]+$", 1)
    own = F.filter(relations, lambda r: (r["alias"] == qualifier) | (F.lower(r["name"]) == qualifier))
    near = F.when(qualifier == "", relations).otherwise(own)
    names = F.array_distinct(F.transform(near, lambda r: F.lower(r["name"])))
    status = (
        F.when(F.size(names) == 0, F.when(qualifier == "", "no_table").otherwise("unknown_alias"))
        .when(F.size(names) > 1, F.when(qualifier == "", "unqualified_ambiguous").otherwise("alias_ambiguous"))
        .when(F.exists(near, lambda r: r["cte"]), "cte")
        .otherwise(F.when(qualifier == "", "sole_table").otherwise("alias"))
    )
    return F.struct(ref.alias("reference"), F.when(status.isin("alias", "sole_table"), names[0]).alias("resolved_table"), status.alias("status"))


def field_ref(r: Column) -> Column:
    """field://table/column of a resolved reference; null where it is not resolved."""
    return F.concat(F.lit("field://"), r["resolved_table"], F.lit("/"), F.substring_index(r["reference"], ".", -1))


def alias_map(s: DataFrame) -> DataFrame:
    """(key, alias, table_name, is_cte): every relation of a statement."""
    return s.select("key", F.explode("relations").alias("r")).select("key", F.col("r.alias").alias("alias"), F.col("r.name").alias("table_name"), F.col("r.cte").alias("is_cte"))


def column_facts(s: DataFrame) -> DataFrame:
    """(key, reference, resolved_table, status, field_ref): every column a statement names."""
    rows = s.select("key", "relations", F.explode(references(F.col("b"), F.col("relations"), F.col("ctes"))).alias("ref"))
    rows = rows.select("key", resolve(F.col("ref"), F.col("relations")).alias("r"))
    return rows.select("key", "r.reference", "r.resolved_table", "r.status", field_ref(F.col("r")).alias("field_ref"))


def projection_facts(s: DataFrame) -> DataFrame:
    """(key, place, output, role, aggregates, windowed, fields, signature): the outermost select list, common table expressions skipped.

    aggregates and fields are sorted and joined by commas; fields are those that resolve. Equal signatures mean the same
    role, aggregates and fields.
    """
    body = F.regexp_replace("b", rf"(?i)^with\s+(?:\w+\s+as\s*{nested(4)}\s*,?\s*)+", "")
    listed = F.regexp_extract(body, r"(?i)^select\s+(?:distinct\s+)?(.*?)\s+from\b", 1)
    rows = s.select("key", "relations", "ctes", F.posexplode(F.regexp_extract_all(listed, F.lit(item_pattern()), 0)).alias("at", "item"))
    rows = rows.withColumn("item", F.trim("item")).withColumn("expr", F.regexp_replace("item", OUTPUT, ""))
    named = F.regexp_replace(F.regexp_extract("item", OUTPUT, 1), r'["`]', "")
    plain = F.when(F.col("item").rlike(r"^[\w.]+$"), F.substring_index("item", ".", -1))
    aggregates = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("expr", F.lit(rf"(?i)\b({'|'.join(AGGREGATES)})\s*\("), 1), lambda x: F.lower(x))))
    refs = F.transform(references(F.col("expr"), F.col("relations"), F.col("ctes")), lambda x: field_ref(resolve(x, F.col("relations"))))
    rows = rows.select(
        "key", (F.col("at") + 1).alias("place"), F.when(named != "", named).otherwise(plain).alias("output"),
        F.array_join(aggregates, ",").alias("aggregates"), F.col("expr").rlike(r"(?i)\bover\s*\(").alias("windowed"),
        F.col("expr").rlike(r"^(?:\w+\.)?\*$").alias("_all"), F.array_join(F.array_sort(F.array_distinct(F.array_compact(refs))), ",").alias("fields"),
    )
    role = F.when(F.col("_all"), "wildcard").when((F.col("aggregates") != "") | F.col("windowed"), "measure_candidate").otherwise("dimension_candidate")
    rows = rows.withColumn("role", role)
    return rows.withColumn("signature", F.substring(F.sha2(F.concat_ws("|", "role", "aggregates", "fields"), 256), 1, 20)).drop("_all")


def join_facts(s: DataFrame) -> DataFrame:
    """(key, place, kind, target, condition, using_columns): the joins of a statement in order; a bare JOIN is inner."""
    marked = F.regexp_replace("b", r"(?i)\b((?:(?:left|right|full|cross|inner)\s+(?:outer\s+)?)?join)\b", "\u0001$1")
    rows = s.select("key", F.posexplode(F.split(marked, "\u0001")).alias("place", "piece")).filter("place > 0")
    piece = F.regexp_replace("piece", r"(?i)\s(?:where|group\s+by|order\s+by|having|limit|union)\b.*$", "")
    kind = F.lower(F.regexp_extract(piece, r"(?i)^(left|right|full|cross|inner)\b", 1))
    some = lambda c: F.when(c != "", c)
    return rows.select(
        "key", "place", F.when(kind == "", "inner").otherwise(kind).alias("kind"),
        some(F.regexp_replace(F.regexp_extract(piece, rf"(?i)\bjoin\s+({NAME})", 1), r"[`\"\s]", "")).alias("target"),
        some(F.trim(F.regexp_extract(piece, r"(?i)\bon\s+(.*)$", 1))).alias("condition"),
        some(F.trim(F.regexp_extract(piece, r"(?i)\busing\s*\(([^)]*)\)", 1))).alias("using_columns"),
    )


def clause_facts(s: DataFrame) -> DataFrame:
    """(key, where_text, group_by, order_by, placeholders, numbers): clause texts and counts of ? (string literals too) and numbers.

    where_text is the first WHERE; group_by and order_by count the items of the outermost statement.
    """
    b = F.col("b")
    outer = F.regexp_replace(b, nested(4), "()")
    some = lambda x: F.coalesce(x, F.lit(""))
    return s.select(
        "key", where_text(b).alias("where_text"),
        F.size(F.regexp_extract_all(some(clause(outer, r"group\s+by", r"order\s+by|having|limit")), F.lit(item_pattern()), 0)).alias("group_by"),
        F.size(F.regexp_extract_all(some(clause(outer, r"order\s+by", "limit")), F.lit(item_pattern()), 0)).alias("order_by"),
        F.size(F.regexp_extract_all(b, F.lit(r"\?"), 0)).alias("placeholders"),
        F.size(F.regexp_extract_all(b, F.lit(r"(?:^|[\s(,=<>])(\d+(?:\.\d+)?)\b"), 1)).alias("numbers"),
    )


def conjuncts(s: DataFrame) -> DataFrame:
    """(key, conjunct): tests of WHERE that AND joins, tautologies such as 1 = 1 left out; the AND of BETWEEN stays inside."""
    held = F.regexp_replace(where_text(F.col("b")), r"(?i)(\bbetween\s+\S+)\s+and\s+", "$1 \u0001 ")
    parts = F.transform(F.split(held, r"(?i)\s+and\s+"), lambda x: F.replace(F.trim(x), F.lit("\u0001"), F.lit("and")))
    kept = F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^\(*\s*(\d+)\s*=\s*\1\s*\)*$"))
    return s.select("key", F.explode(kept).alias("conjunct")).distinct()


def needed_columns(s: DataFrame) -> DataFrame:
    """(key, table_name, columns, reads): for each table of a statement the projection that serves it, its columns alone."""
    facts = column_facts(s).filter("resolved_table IS NOT NULL")
    g = facts.groupBy("key", F.col("resolved_table").alias("table_name")).agg(F.array_join(F.array_sort(F.collect_set(F.substring_index("reference", ".", -1))), ", ").alias("columns"))
    return g.withColumn("reads", F.concat(F.lit("SELECT "), "columns", F.lit(" FROM "), "table_name"))
