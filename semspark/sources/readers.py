"""Readers and writers: CSV, JSON, JSON lines, workbooks, file snapshots and day spines."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None, key: str | None = None) -> DataFrame:
    """A CSV file with a header; without a schema all columns are strings. Rows whose ``key`` is blank are left out."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.filter(F.trim(F.col(key)) != "") if key else df


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Whole-file JSON documents."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a path that does not exist gives an empty table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def file_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def day_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """date_day from ``start`` to the day before ``end``."""
    return spark.sql("SELECT explode(sequence(date(:a), date(:b) - INTERVAL 1 DAY)) AS date_day WHERE date(:a) < date(:b)", args={"a": start, "b": end})


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def active_sheet(book: zipfile.ZipFile) -> str:
    """File of the sheet that the workbook opens with; without a list of sheets, the one with the least number."""
    names = book.namelist()
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(names):
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        view, sheets = root.find(f".//{SHEET}workbookView"), root.findall(f".//{SHEET}sheet")
        number = int(view.get("activeTab", 0)) if view is not None else 0
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = links[next(v for k, v in sheets[number].attrib.items() if k.endswith("}id"))]
        return target.removeprefix("/") if target.startswith("/") else f"xl/{target}"
    return min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))


def sheet_rows(data: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells as text) of the active sheet of a workbook."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = book.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
    for row in ElementTree.fromstring(book.read(active_sheet(book))).iter(f"{SHEET}row"):
        cells: list[str | None] = []
        for c in row.iter(f"{SHEET}c"):
            at = _column(c.get("r"))
            cells += [None] * (at + 1 - len(cells))
            v, t = c.find(f"{SHEET}v"), c.get("t")
            if t == "inlineStr":
                cells[at] = "".join(x.text or "" for x in c.iter(f"{SHEET}t"))
            elif v is not None:
                cells[at] = shared[int(v.text)] if t == "s" else v.text
        yield int(row.get("r")), cells


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").option("columns", "a,b").load(path)``: the named columns of a sheet as text.

    Row 1 holds the header; a missing column is an error; short rows end in nulls; rows whose named cells are all
    blank are left out; _row_number counts rows of the sheet. A workbook is one partition.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        names = [c.strip() for c in self.options["columns"].split(",")]
        return StructType([StructField(n, StringType()) for n in names] + [StructField("_row_number", IntegerType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"], schema.names[:-1])


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.path.split(";")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value.removeprefix("file://"), "rb") as f:
            rows = sheet_rows(f.read())
        header = [(h or "").strip() for h in next(rows)[1]]
        lost = [n for n in self.names if n not in header]
        if lost:
            raise ValueError(f"columns not in the header: {lost}")
        at = [header.index(n) for n in self.names]
        for number, cells in rows:
            own = [cells[i] if i < len(cells) else None for i in at]
            if any(c and c.strip() for c in own):
                yield (*own, number)
