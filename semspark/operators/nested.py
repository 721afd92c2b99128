"""Nested JSON documents as an adjacency table, and entity tables made from it by joins.

``shred`` stores each document as rows (node, parent, label, ordinal, kind, scalar). Everything after it is
relational: ``list_elements`` joins arrays with their children, ``entity`` joins object nodes with their scalar
children and pivots these into columns.

Defined results: null, unparsable and non-object documents give no node or no report; an object that repeats a
field keeps its last value; a document encoded as a JSON string is decoded again, up to ``decode`` times;
rows sent twice count once; an empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

# Fields of a report object, and its lists.
REPORT_FIELDS = ["report_path", "report_path_segments", "components", "mapping", "status"]
LISTS = ["report_path_segments", "components", "sql_list", "queries", "physical_tables"]
BATCH = 50_000


class _Number(str):
    """A number as it is written, so that long ones keep all their digits."""


def _not_json(name: str) -> None:
    raise ValueError(name)


def _kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, _Number):
        return "number"
    return "string" if isinstance(value, str) else "number"


def _nodes(text: str | None, decode: int) -> list[tuple]:
    """(node, parent, label, ordinal, kind, scalar) of one document, or nothing if it is not JSON."""
    value: object = text
    try:
        for _ in range(decode):
            if not isinstance(value, str) or isinstance(value, _Number):
                break
            value = json.loads(value, parse_float=_Number, parse_int=_Number, parse_constant=_not_json)
    except (ValueError, RecursionError):
        return []
    rows, todo = [], [(value, 0, None, 1)]
    while todo:
        value, parent, label, ordinal = todo.pop()
        node, kind = len(rows) + 1, _kind(value)
        scalar = None
        if kind == "object":
            todo.extend((v, node, k, i) for i, (k, v) in enumerate(value.items(), 1))
        elif kind == "array":
            todo.extend((v, node, None, i) for i, v in enumerate(value, 1))
        elif kind == "string":
            scalar = value.encode("utf-8", "replace").decode()
        elif kind == "number":
            scalar = str(value)
        elif kind == "boolean":
            scalar = json.dumps(value)
        rows.append((node, parent, label and label.encode("utf-8", "replace").decode(), ordinal, kind, scalar))
    return rows


def shred(df: DataFrame, keys: list[str], text: str, decode: int = 2) -> DataFrame:
    """Adjacency table of the JSON documents in ``text``: keys, node, parent, label, ordinal, kind, scalar.

    Nodes are numbered within a document, the root is 1 and its parent 0; ordinals count from 1.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    names = [*keys, "node", "parent", "label", "ordinal", "kind", "scalar"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch[[*keys, text]].itertuples(index=False, name=None):
                own = tuple(None if pd.isna(k) else k for k in row[:-1])
                out.extend(own + n for n in _nodes(row[-1] if isinstance(row[-1], str) else None, decode))
                if len(out) >= BATCH:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return df.select(*keys, text).mapInPandas(run, f"{schema}, node int, parent int, label string, ordinal int, kind string, scalar string")


def not_blank(kind: Column, scalar: Column) -> Column:
    return (kind != "null") & ((kind != "string") | scalar.rlike(r"(?U)\S"))


def list_elements(nodes: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Elements of the lists named: keys, owner, list, place, node, kind, scalar. A single value is its own first element."""
    lists = nodes.filter((F.col("kind") == "array") & F.col("label").isin(labels)).select(*keys, F.col("node").alias("parent"), F.col("parent").alias("owner"), F.col("label").alias("list"))
    children = nodes.filter(F.col("label").isNull()).drop("label")
    inside = children.join(lists, [*keys, "parent"]).select(*keys, "owner", "list", F.col("ordinal").alias("place"), "node", "kind", "scalar")
    single = nodes.filter(F.col("label").isin(labels) & ~F.col("kind").isin("array", "null"))
    return inside.unionByName(single.select(*keys, F.col("parent").alias("owner"), F.col("label").alias("list"), F.lit(1).alias("place"), "node", "kind", "scalar"))


def entity(objects: DataFrame, nodes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``objects`` (keys, node, ...) with a text column for each scalar field named; absent fields are null."""
    scalars = nodes.filter(F.col("label").isin(fields) & F.col("scalar").isNotNull())
    wide = scalars.groupBy(*keys, F.col("parent").alias("node")).agg(*[F.max(F.when(F.col("label") == f, F.col("scalar"))).alias(f) for f in fields])
    return objects.join(wide, [*keys, "node"], "left")


class ReportTables:
    """Flat tables of exported reports, each row with its record and its place under its parent.

    ``records`` needs record_id, report_id, exported_at and doc_json. Records that repeat a record_id with other
    content are kept apart by a hash of the row.
    """

    KEYS = ["record_id", "version"]

    def __init__(self, records: DataFrame):
        rows = records.select("record_id", "report_id", "exported_at", "doc_json").filter(F.col("doc_json").isNotNull()).distinct()
        rows = rows.withColumn("version", F.xxhash64("report_id", "exported_at", "doc_json"))
        self._rows = rows
        self.nodes = materialise(shred(rows, ["record_id", "version", "report_id"], "doc_json"), "report_nodes")
        self.elements = materialise(list_elements(self.nodes, self.KEYS, LISTS), "report_elements")

    @cached_property
    def records(self) -> DataFrame:
        """(record_id, version, report_id, exported_at, copy_no): copy_no counts the records that share the other three, from 1, in the order of their SHA-256."""
        same = W.partitionBy("record_id", "report_id", "exported_at").orderBy("digest")
        return materialise(self._rows.select(*self.KEYS, "report_id", "exported_at", F.sha2("doc_json", 256).alias("digest")).withColumn("copy_no", F.row_number().over(same)).drop("digest"), "records")

    @cached_property
    def _reports(self) -> DataFrame:
        """The report object of each record: at the top, or under the record's report id."""
        k, n = self.KEYS, self.nodes
        fields = n.filter(F.col("label").isin(REPORT_FIELDS)).select(*k, F.col("parent").alias("node")).distinct()
        objects = n.filter((F.col("kind") == "object") & ((F.col("node") == 1) | ((F.col("parent") == 1) & (F.col("label") == F.col("report_id")))))
        found = objects.join(fields, [*k, "node"], "left_semi")
        return materialise(found.groupBy(*k).agg(F.min("node").alias("node")), "reports")

    def reports(self) -> DataFrame:
        """The report object of each record."""
        return self._reports

    def segments(self) -> DataFrame:
        e = self.elements.filter((F.col("list") == "report_path_segments") & not_blank(F.col("kind"), F.col("scalar")))
        return e.join(self.reports().withColumnRenamed("node", "owner"), [*self.KEYS, "owner"]).select(*self.KEYS, F.col("place").alias("item_no"), F.col("scalar").alias("segment"))

    @cached_property
    def _components(self) -> DataFrame:
        e = self.elements.filter((F.col("list") == "components") & (F.col("kind") == "object"))
        return materialise(e.join(self.reports().withColumnRenamed("node", "owner"), [*self.KEYS, "owner"]).select(*self.KEYS, F.col("place").alias("component_no"), "node"), "components")

    def components(self) -> DataFrame:
        return self._components

    def datasets(self) -> DataFrame:
        d = self.nodes.filter((F.col("label") == "dataset") & (F.col("kind") == "object")).select(*self.KEYS, F.col("parent").alias("owner"), "node")
        return d.join(self.components().withColumnRenamed("node", "owner"), [*self.KEYS, "owner"]).drop("owner")

    def statements(self) -> DataFrame:
        """Of a dataset with both layouts, sql_list counts."""
        return self._statements

    @cached_property
    def _statements(self) -> DataFrame:
        k = self.KEYS
        s = self.elements.filter(F.col("list").isin("sql_list", "queries"))
        s = s.join(self.datasets().withColumnRenamed("node", "owner"), [*k, "owner"])
        twice = s.groupBy(*k, "owner").agg(F.max("list").alias("list"))
        s = s.join(twice, [*k, "owner", "list"], "left_semi")
        said = (F.col("kind") == "object") | ((F.col("kind") == "string") & F.col("scalar").rlike(r"(?U)\S"))
        return materialise(s.filter(said).select(*k, "component_no", F.col("place").alias("statement_no"), "node", F.col("scalar").alias("text")), "statements")

    def physical_tables(self) -> DataFrame:
        e = self.elements.filter((F.col("list") == "physical_tables") & not_blank(F.col("kind"), F.col("scalar"))).withColumnRenamed("node", "item")
        owners = self.statements().drop("text").withColumnRenamed("node", "owner")
        return e.join(owners, [*self.KEYS, "owner"]).select(*self.KEYS, "component_no", "statement_no", F.col("place").alias("item_no"), F.col("item").alias("node"), F.col("scalar").alias("table_name"))

    def places(self) -> DataFrame:
        """record_id, node_kind, component_no, statement_no, item_no: one row for each segment, component, statement and table.

        Records of one record_id share their places; the entity tables keep them apart.
        """
        zero = F.lit(0)

        def rows(df: DataFrame, kind: str, *at: Column) -> DataFrame:
            return df.select("record_id", F.lit(kind).alias("node_kind"), *[c.cast("int").alias(n) for c, n in zip(at, ("component_no", "statement_no", "item_no"), strict=True)])

        c, s, i = F.col("component_no"), F.col("statement_no"), F.col("item_no")
        out = rows(self.segments(), "segment", zero, zero, i)
        for part in (rows(self.components(), "component", c, zero, zero), rows(self.statements(), "statement", c, s, zero), rows(self.physical_tables(), "physical_table", c, s, i)):
            out = out.unionByName(part)
        return out.distinct()

    def table(self, rows: DataFrame, *columns: str | Column) -> DataFrame:
        """``rows`` with the record that holds them: record_id, report_id, exported_at and, where several records share these, copy_no."""
        return rows.join(self.records, self.KEYS).select("record_id", "report_id", "exported_at", "copy_no", *columns)


def report_table(t: ReportTables) -> DataFrame:
    """A row per report: record_id, report_id, exported_at, copy_no, report_path, status."""
    return t.table(entity(t.reports(), t.nodes, t.KEYS, ["report_path", "status"]), "report_path", "status")


def segment_table(t: ReportTables) -> DataFrame:
    """A row per path segment: its record, item_no, segment (null where it is no scalar)."""
    return t.table(t.segments(), "item_no", "segment")


def component_table(t: ReportTables) -> DataFrame:
    """A row per component: its record, component_no, component_name, dataset_path, dataset_status."""
    own = entity(t.components(), t.nodes, t.KEYS, ["component_name"]).drop("node")
    data = entity(t.datasets(), t.nodes, t.KEYS, ["dataset_path", "status"]).drop("node").withColumnRenamed("status", "dataset_status")
    return t.table(own.join(data, [*t.KEYS, "component_no"], "left"), "component_no", "component_name", "dataset_path", "dataset_status")


def statement_table(t: ReportTables) -> DataFrame:
    """A row per statement: its record, component_no, statement_no, sql, occurrence_count."""
    rows = entity(t.statements(), t.nodes, t.KEYS, ["sql", "occurrence_count"])
    return t.table(rows, "component_no", "statement_no", F.coalesce("sql", "text").alias("sql"), F.expr("try_cast(occurrence_count AS bigint)").alias("occurrence_count"))


def physical_table_table(t: ReportTables) -> DataFrame:
    """A row per physical table: its record, component_no, statement_no, item_no, table_name (null where it is no scalar)."""
    return t.table(t.physical_tables(), "component_no", "statement_no", "item_no", "table_name")
