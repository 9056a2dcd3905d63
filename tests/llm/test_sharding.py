from __future__ import annotations

import zlib
from collections import Counter

from tesserae.llm import sharding


def test_law_and_checksums(spark, docs, rows):
    many = docs.unionByName(spark.createDataFrame([(7, "x")] * 300, "doc_id long, text string"), allowMissingColumns=True)
    got = sharding.report(many, 24, bucket_bytes=100_000).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in [*rows, *[(7, "x")] * 300])
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for k, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n))
    # copies spread: each shard has some
    assert all(any(r.doc_id == 7 for r in got if r.shard == k) for k in range(24))


def test_records_are_whole_and_buckets_shuffled(spark, docs, tmp_path):
    out = sharding.external_shuffle(docs, str(tmp_path / "s"), 3, bucket_bytes=60_000)
    assert set(out.columns) == set(docs.columns)
    assert Counter(r.text for r in out.collect()) == Counter(r.text for r in docs.collect())
    assert out.select("bucket").distinct().count() > 1
    ids = [r.doc_id for r in out.where("shard = 0").orderBy("slot").collect()]
    assert ids != sorted(ids, key=lambda x: (x is None, x))


def test_same_seed_same_order(spark, tmp_path):
    df = spark.range(500).selectExpr("id as doc_id", "repeat('x', cast(id % 7 as int)) as text")
    order = lambda k, seed: [r.doc_id for r in sharding.external_shuffle(df, str(tmp_path / k), 2, seed=seed).orderBy("shard", "slot").collect()]
    assert order("a", 1) == order("b", 1) != order("c", 2)


def test_order_follows_from_seed_and_records_alone(spark, tmp_path):
    df = spark.range(1_000).selectExpr("id % 900 as doc_id", "repeat('x', cast(id % 7 as int)) as text", "id % 450 as _at", "1 as _start")
    df = df.unionByName(spark.createDataFrame([(5, "same", 1, 1)] * 40, df.schema))
    order = lambda d, k: [tuple(r) for r in sharding.external_shuffle(d, str(tmp_path / k), 3, bucket_bytes=4_000).orderBy("shard", "slot").select("shard", "slot", "doc_id", "text", "_at").collect()]
    assert order(df, "a") == order(df.repartition(7), "b") and len(order(df.coalesce(1), "c")) == 1_040


def test_names_that_the_operator_uses(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2, 3, 4, 5, 6, 7, 8, 9)], "doc_id long, text string, _at int, _start int, at int, start int, _row int, _h int, _n int, _part int")
    out = sharding.external_shuffle(df, str(tmp_path / "s"), 2)
    assert set(out.columns) == {*df.columns, *sharding.OWN} and tuple(out.select(*df.columns).first()) == tuple(df.first())
    assert sharding.report(df).count() == 1


def test_several_buckets_a_partition(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_PARTITIONS", 3)
    df = spark.range(400).selectExpr("id as doc_id", "repeat('x', 20) as text")
    out = [sharding.external_shuffle(d, str(tmp_path / k), 2, bucket_bytes=4_000).orderBy("shard", "slot").select("doc_id", "bucket").collect() for k, d in (("a", df), ("b", df.repartition(5)))]
    assert out[0] == out[1] and sorted(r.doc_id for r in out[0]) == list(range(400)) and len({r.bucket for r in out[0]}) > 3


def test_nothing(nothing):
    assert sharding.report(nothing).count() == 0
