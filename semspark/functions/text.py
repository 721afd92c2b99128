"""Text and code normalisation as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aggregate prefixes, characters that labels are compared without, and labels that say nothing.
AGGREGATE_PREFIX = r"(?i)^(?:sum|avg|average|max|min|count)[_\-\s]+"
LABEL_NOISE = r"[\s_\-（）()【】\[\]]+"
GENERIC_LABEL = r"(?i)^(?:LONG_COL_?\d+|COL_?\d+|c\d+|图表\d*|组件\d*)$"


def loose_code(code: Column) -> Column:
    """Trimmed of blanks and tabs, in capitals; null where nothing is left."""
    bare = F.upper(F.trim(code, F.lit(" \t")))
    return F.when(bare != "", bare)


def text_or_null(text: Column) -> Column:
    """Stripped of any Unicode white space at both ends; null where nothing is left."""
    bare = F.regexp_replace(text.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.when(bare != "", bare)


def clean_sql(sql: Column) -> Column:
    """Spreadsheet line ends become line ends, runs of blanks one blank, blank lines go; null where nothing is left."""
    lines = F.split(F.regexp_replace(F.regexp_replace(sql, r"_x000D_\s*", "\n"), r"[ \t]+", " "), r"\r?\n")
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))


def path_segments(path: Column) -> Column:
    """Segments of a path split at either slash, trimmed, empty ones left out."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def empty_segment_places(path: Column) -> Column:
    """Places (from 1) of empty segments; a slash at either end makes one."""
    parts = F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: F.trim(x))
    marked = F.transform(parts, lambda x, i: F.when(x == "", i + 1).otherwise(F.lit(0)))
    return F.filter(marked, lambda x: x > 0)


def normalize_label(label: Column, brackets: bool = True) -> Column:
    """Without aggregate prefix, white space, dashes (and brackets), in small letters."""
    noise = LABEL_NOISE if brackets else r"[\s_\-]+"
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(label), AGGREGATE_PREFIX, ""), noise, ""))


def is_generic_label(label: Column) -> Column:
    return F.coalesce(F.trim(label).rlike(GENERIC_LABEL), F.lit(False))


def char_jaccard(a: Column, b: Column, places: int = 4) -> Column:
    """Jaccard likeness of the sets of characters of two normalised labels; 0 where either is null or empty."""
    chars = lambda x: F.filter(F.array_distinct(F.split(normalize_label(F.coalesce(x, F.lit(""))), "")), lambda c: c != "")
    both, either = F.size(F.array_intersect(chars(a), chars(b))), F.size(F.array_union(chars(a), chars(b)))
    share = F.try_divide(both.cast("double"), either.cast("double"))
    return F.floor(F.coalesce(share, F.lit(0.0)) * 10**places + 0.5) / 10**places


def make_ref(kind: str, *parts: Column) -> Column:
    """``kind://a/b/c`` with slashes at the ends of each part left out; null parts are skipped."""
    return F.concat(F.lit(f"{kind}://"), F.concat_ws("/", *[F.trim(p.cast("string"), F.lit("/")) for p in parts]))


def fingerprint(*fields: str) -> Column:
    """SHA-256 of the canonical JSON of the columns named: keys in order, nulls kept, no spaces."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def redact(text: Column) -> Column:
    """Values of keys, tokens and passwords hidden, as ``name=***``."""
    return F.regexp_replace(text, r"(?i)\b((?:api[_-]?)?key|token|secret|password|authorization)(\"?\s*[=:]\s*\"?|\s+)(?:bearer\s+)?[^\s\",;&]+", "$1$2***")
