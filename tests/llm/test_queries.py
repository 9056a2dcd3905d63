"""The queries that SQL can express, against DuckDB; all of them over whole tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tesserae.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.sql(queries.SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize(("name", "of"), [("op1_pii", "documents"), ("op2_sharding", "documents"), ("op3_secrets", "documents"), ("op4_quality", "documents"), ("op9_langid", "documents")])
def test_a_row_for_each_row(spark, name, of):
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{of}.parquet").count()
