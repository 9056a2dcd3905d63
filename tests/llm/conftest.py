from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
ODD = [(-1, None), (-2, ""), (-3, " \t\n"), (None, "x y z q"), (None, "x y z q"), (-5, "Ä ß é 😀 ok"), (-6, "a " * 20_000), (-7, "b" * 50_000)]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents, odd rows among them, some rows twice, and columns whose names operators use themselves."""
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    out = own.unionByName(odd).unionByName(own.limit(4))
    return out.selectExpr("*", "'k' as shard", "1 as slot", "2 as bucket", "3 as n_words", "'q' as lang", "4 as kept", "5 as length", "'r' as blob", "6 as node", "7 as part", "8 as _id", "9 as _h", "10 as row", "11 as h0", "12 as _at", "13 as _start", "14 as _text", "15 as _base", "16 as term", "17 as c", "18 as _n").cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
