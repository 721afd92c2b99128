"""The JSON object in a model's response, and how it breaks the contract of its fields.

As in the reference, a fence around the whole response is taken off; the rest is the object, else the object is what
starts at the first brace, whatever follows it.

Defined results: null and blank responses have no object; a repeated row counts once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_or_null


def _parses(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def first_object(text: Column) -> Column:
    """What starts at the first brace, up to the first closing one with which it parses; null if it never does."""
    parts = F.split(F.substring(text, F.instr(text, "{"), F.length(text)), r"\}", -1)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "}"), F.lit("}")))
    return F.when((F.instr(text, "{") > 0) & (F.size(parts) > 1), F.try_element_at(F.filter(starts, _parses), F.lit(1)))


def findings(df: DataFrame, key: str, response: str, fields: list[str]) -> DataFrame:
    """(key, extra_fields, missing_fields, has_sql, violation) of each distinct response.

    violation: absent (no object), unparsable, not_object (other JSON), fields (extra or missing ones), no_sql (sql is
    no text); null where the contract holds. Without an object the numbers of fields are null.
    """
    rows = df.select(F.col(key).alias("key"), F.col(response).alias("response")).distinct()
    text = text_or_null(F.col("response"))
    bare = F.when(text.startswith("```"), text_or_null(F.regexp_replace(F.regexp_replace(text, r"^```[^\r\n]*", ""), r"(^|[\r\n])[ \t]*```$", ""))).otherwise(text)
    rows = rows.select("key", bare.alias("text")).withColumn("whole", _parses(F.col("text")))
    rows = rows.withColumn("object", F.when(F.col("whole"), F.col("text")).otherwise(first_object(F.col("text"))))
    rows = rows.withColumn("keys", F.when(F.col("object").isNotNull(), F.json_object_keys("object")))
    allowed = F.array(*[F.lit(c) for c in fields])
    extra, missing = F.size(F.array_except("keys", allowed)), F.size(F.array_except(allowed, F.col("keys")))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("object"), "$.sql", "variant"))
    has = F.col("keys").isNotNull()
    rows = rows.withColumns({"extra_fields": F.when(has, extra), "missing_fields": F.when(has, missing), "has_sql": has & F.coalesce(kind == "STRING", F.lit(False))})
    violation = (
        F.when(F.col("object").isNotNull() & ~has, "not_object")
        .when(F.col("text").isNull() | (F.instr("text", "{") == 0), "absent")
        .when(~has, "unparsable")
        .when((F.col("extra_fields") > 0) | (F.col("missing_fields") > 0), "fields")
        .when(~F.col("has_sql"), "no_sql")
    )
    return rows.select("key", "extra_fields", "missing_fields", "has_sql", violation.alias("violation"))
