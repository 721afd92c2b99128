import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from semspark.queries import assets, mining, problems, reference

REPO = Path(entry.__file__).parent
CORE = {**problems.SQL, **reference.SQL, **mining.SQL, **assets.SQL}


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else str(v) if not isinstance(v, (int, str, bool, type(None))) else v


def sets(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in Path(small).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, rel = entry.queries()[name](spark, small), con.sql(CORE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sets(df.columns, df.collect()) == sets(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted((set(problems.QUERIES) | set(reference.QUERIES) | set(mining.QUERIES) | set(assets.QUERIES)) - set(CORE)))
def test_query_without_sql_has_rows_and_no_empty_column(spark, small, name):
    df = entry.queries()[name](spark, small)
    row = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    assert row["n"] > 0 and all(row[f"c{i}"] > 0 for i in range(len(df.columns)) if df.columns[i] != "row_limit")


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_the_llm_subpackage(tmp_path):
    shutil.copytree(REPO / "semspark", tmp_path / "semspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(q.startswith(('p4_', 'p5_')) for q in e.queries()); assert 'p1_found' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode == 0
    importlib.import_module("semspark.queries")
