"""Facts about SQL texts as Column expressions, so that logs of any size are mined where they lie.

Nothing here parses SQL: these are patterns over text, and they say what they can tell (a text that starts neither
with SELECT nor WITH gives no facts). Defined results: null gives null, or an empty array or map.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES = ("sum", "avg", "min", "max", "count")
NAME = r"[\w`\"]+(?:\s*\.\s*[\w`\"]+){0,2}"


def is_query(sql: Column) -> Column:
    return F.coalesce(sql.rlike(r"(?is)^\s*(--[^\n]*\n\s*)*(select|with)\b"), F.lit(False))


def bare(sql: Column) -> Column:
    """Without comments and spreadsheet line ends, white space made single."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(sql, F.lit("_x000D_"), F.lit(" ")), r"(?s)--[^\n]*|/\*.*?\*/", " "), r"\s+", " "))


def structural(sql: Column) -> Column:
    """Literals and placeholders as ?, in small letters: equal for queries that differ in constants only."""
    text = F.regexp_replace(bare(sql), r"'(?:[^']|'')*'", "?")
    return F.lower(F.regexp_replace(text, r"(?<![\w.\"])\d+(?:\.\d+)?(?![\w\"])", "?"))


def exact_fingerprint(sql: Column) -> Column:
    return F.sha2(sql, 256)


def structural_fingerprint(sql: Column) -> Column:
    return F.sha2(structural(sql), 256)


def cte_names(sql: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(bare(sql), F.lit(r"(?i)(?:\bwith|,)\s+(\w+)\s+as\s*\(\s*select"), 1), lambda x: F.lower(x)))


def tables(sql: Column) -> Column:
    """Tables after FROM and JOIN, in order of first mention, common table expressions left out."""
    found = F.regexp_extract_all(bare(sql), F.lit(rf"(?i)\b(?:from|join)\s+({NAME})"), 1)
    clean = F.transform(found, lambda x: F.regexp_replace(x, r"[`\"\s]", ""))
    return F.filter(F.array_distinct(clean), lambda x: ~F.array_contains(cte_names(sql), F.lower(x)))


def functions(sql: Column) -> Column:
    """Names of called functions, one per call."""
    text = F.regexp_replace(bare(sql), r"'(?:[^']|'')*'|\"[^\"]*\"", "?")
    calls = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b([a-z_]\w*)\s*\("), 1), lambda x: F.lower(x))
    return F.filter(calls, lambda x: ~x.isin("in", "as", "and", "or", "on", "not", "exists", "over", "by", "select", "from", "where", "join", "with", "values", "then", "else", "when"))


def aggregates(sql: Column) -> Column:
    return F.filter(functions(sql), lambda x: x.isin(*AGGREGATES))


def join_kinds(sql: Column) -> Column:
    """Kinds of the joins in order; a bare JOIN is inner."""
    kinds = F.regexp_extract_all(bare(sql), F.lit(r"(?i)\b(?:(left|right|full|cross|inner)\s+(?:outer\s+)?)?join\b"), 1)
    return F.transform(kinds, lambda x: F.when(x == "", "inner").otherwise(F.lower(x)))


def aliases(sql: Column) -> Column:
    """Output names given by AS, quotes taken off."""
    return F.transform(F.regexp_extract_all(bare(sql), F.lit(r"(?i)\bas\s+(\"[^\"]+\"|`[^`]+`|\w+)\s*(?=,|\bfrom\b)"), 1), lambda x: F.regexp_replace(x, r"[\"`]", ""))


def clause(sql: Column, start: str, stops: str) -> Column:
    text = F.regexp_extract(bare(sql), rf"(?i)\b{start}\b\s*(.*?)\s*(?:\b(?:{stops})\b|$)", 1)
    return F.when(text != "", text)


def where_text(sql: Column) -> Column:
    return clause(sql, "where", r"group\s+by|order\s+by|having|limit")


def group_text(sql: Column) -> Column:
    return clause(sql, r"group\s+by", r"order\s+by|having|limit")


def limit_number(sql: Column) -> Column:
    found = F.regexp_extract(bare(sql), r"(?i)\blimit\s+(\d{1,9})\s*;?$", 1)
    return F.when(found != "", found.cast("int"))


def has_window(sql: Column) -> Column:
    return F.coalesce(bare(sql).rlike(r"(?i)\)\s*over\s*\("), F.lit(False))


def has_equality(sql: Column, column: str, value: str | None = None) -> Column:
    """Whether WHERE tests ``column`` with = or IN (against ``value``, if given): a mandatory-filter rule on the clause, not on any text."""
    want = rf"'{value}'" if value is not None else r"(?:'[^']*'|\?|\d+)"
    return F.coalesce(where_text(sql).rlike(rf"(?i)(?<!\w){column}\s*(?:=\s*{want}|in\s*\([^)]*{want})"), F.lit(False))
