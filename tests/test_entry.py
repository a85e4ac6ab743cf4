"""Queries against their SQL, and the guard for the optional subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

from quarry.plans.oracles import ORACLES
from quarry.plans.queries import QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, run, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = run(spark, SF), con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    a = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in order]
    b = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_query(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_the_subpackage(tmp_path, gone):
    """The rest imports and runs when the training-data operators are gone, with their pipeline or without it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    import shutil

    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__"))
    code = f"""
import __spark_entry__ as e
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("out", len(e.queries()), "pipeline" in e.queries(), set(e.oracle_sql()) <= set(e.queries()), e.queries()["catalogue_eligible"](s, "{SF}").count() > 0)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=300)
    assert out.stdout.split("out ")[-1].split() == [str(len(QUERIES)), "False", "True", "True"], out.stderr
