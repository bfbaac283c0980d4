"""Every query runs and equals its SQL on the smallest tables; the package stands without its corpus part."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from terrashard import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = [tuple(map(plain, r)) for r in got.select(*sorted(got.columns)).collect()]
    assert rows
    if name in catalog.ORACLE:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(catalog.ORACLE[name])
        order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
        assert [want.columns[i] for i in order] == sorted(got.columns)
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(rows, key=key) == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_corpus_part(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "terrashard", tmp_path / "terrashard", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = """
import os, __spark_entry__ as e
from pyspark.sql import SparkSession
assert "pipeline" not in e.queries() and "morton_2d" in e.queries() and not any(k.startswith("op") for k in [*e.queries(), *e.oracle_sql()])
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0 and e.queries()["flatten_tiles"](spark, os.environ["SF"]).count() > 0
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path), "SF": SF})
