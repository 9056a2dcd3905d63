from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import langid


@pytest.fixture(scope="module")
def source(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def net(source):
    return langid.learn(source, docs_each=80, steps=200)


def test_held_out_accuracy(source, net):
    got = langid.predict(source.drop("lang", "source"), net).join(source.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and right >= 0.97 * n


def test_gradients():
    net = langid.Network.new(["a", "b"], 3, 5, 1)
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (5, 4)).astype(np.uint16)
    weight = rng.normal(size=(5, 4, 3))
    for way in (0, 1):
        net.x[way] = net.x[way].astype(np.float64)
        net.u[way] = net.u[way].astype(np.float64)
        loss = lambda: sum((w * s).sum() for w, s in zip(weight, net.states(codes, way), strict=True))  # noqa: B023, E731
        dx, du = langid._backward(net, codes, way, net.states(codes, way), list(weight))
        for table, grad, at in ((net.u[way], du, (1, 4)), (net.u[way], du, (2, 8)), (net.x[way], dx, (codes[2, 1], 0)), (net.x[way], dx, (codes[2, 1], 5))):
            kept, eps = table[at], 1e-4
            table[at] = kept + eps
            up = loss()
            table[at] = kept - eps
            down = loss()
            table[at] = kept
            assert grad[at] == pytest.approx((up - down) / (2 * eps), rel=0.02, abs=2e-3)


def test_pooling_doesn_t_depend_on_the_batch(net):
    texts = [b"the and of there", b"", "Étre de la les que ".encode() * 50, b"x" * 1000]
    together = net.pooled(texts, chunk=256)
    for k, t in enumerate(texts):
        assert np.allclose(together[k], net.pooled([t])[0], atol=1e-5)
    assert together[1].sum() == 0 and np.allclose(together[[0, 2, 3]].sum(axis=1), 1, atol=1e-5)


def test_positions_are_labelled(net):
    runs = net.label("The and of there. Étre de la les que")
    assert runs[0][0] == 0 and runs[-1][1] == len("The and of there. Étre de la les que".encode()) and all(a[1] == b[0] for a, b in zip(runs, runs[1:], strict=False))


def test_defined_results(spark, docs, nothing, net):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 ..."), (None, "the and of"), (5, "ß")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(rows, net).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[None].lang_pred in net.langs and not got[None].held_out
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in (1, 2, 3, 5))
    odd = ["²½", "Ⅷ ٣", "\u0301 ①", "१२", "😀", "ª", "1 ß"]
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), net).collect()}
    assert [told[k] for k in range(5)] == [("und", 0.0)] * 5 and all(told[k][0] in net.langs for k in (5, 6))
    assert langid.predict(docs, net).count() == docs.count() and langid.report(nothing).count() == 0
    assert langid.report(rows.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_repeated_rows_are_learned_from_once(spark, source, monkeypatch):
    given = []
    monkeypatch.setattr(langid, "train", lambda codes, y, langs, **how: given.append((codes.shape, y.tolist(), langs)))
    few = source.where("doc_id < 60")
    langid.learn(few, docs_each=3)
    langid.learn(few.unionAll(few).unionAll(few), docs_each=3)
    assert given[0] == given[1] and given[0][0][1] <= 64
