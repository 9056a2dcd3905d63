"""Every query with SQL against DuckDB over the smallest tables; the others run and keep their schema."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from tesserae.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(row[c]) for c in cols) for row in df.collect()), key=repr)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry_without_corpus_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def guarded(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("tesserae.llm"):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    for m in [m for m in sys.modules if m in ("corpus_pipeline", "__spark_entry__") or m.startswith("tesserae.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", guarded)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(QUERIES)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
