from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.llm import warc
from tesserae.llm.common import fresh_dir

LONG = "é" * 600


def pages(spark):
    own = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = [(901, "u\r\nv", LONG), (902, None, LONG), (903, "a", None), (904, "b", ""), (905, "s", "short"), (906, "s", "short"), (907, "x", "z" * 400_000), (908, "x", LONG)]
    return own.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string")).withColumn("digest", F.lit("d")).withColumn("key", F.lit(1))


def test_against_plain_version(spark):
    df = pages(spark)
    rows = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
    top = {}
    for i, b in rows:
        if len(b) >= 1000:
            top[b] = max(i, top.get(b, i))
    want = Counter((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if top.get(b, i) != i else "response", top[b] if top.get(b, i) != i else None) for i, b in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.report(df).collect()) == want


def test_selected_records_come_back_whole(spark):
    df, folder = pages(spark), fresh_dir(spark, "warc")
    index = warc.write(warc.decide(df), folder)
    html = {r.page_id: (r.html or "").encode() for r in df.collect()}
    got = warc.read(index.where("record_id % 3 = 0 and record_type = 'response'"), folder, gap=0, span=10_000, chunk=5_000).collect()
    assert got and all(bytes(r.payload) == html[r.page_id] and r.page_id % 3 == 0 for r in got)
    assert index.groupBy("archive").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n <> m").count() == 0


def test_null_keys_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", LONG), (None, "b", LONG), (2, "c", LONG), (2, "c", LONG), (None, "q", "y" * 2000), (None, "q", "y" * 2000)], "page_id long, url string, html string")
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.report(df).collect())
    assert got == {(1, "revisit", 2): 1, (None, "revisit", 2): 1, (2, "response", None): 2, (None, "response", None): 2}


def test_ranges_join_only_near_ones():
    assert list(warc.ranges([(0, 10), (10, 10), (25, 5), (100, 5)], 5, 1000)) == [(0, 3, 0, 30), (3, 4, 100, 5)]
    assert list(warc.ranges([(0, 10), (10, 10)], 5, 15)) == [(0, 1, 0, 10), (1, 2, 10, 10)]


def test_a_changed_payload_is_noticed():
    import zlib

    raw = zlib.decompress(warc.record(1, "u", b"payload", "response", None), 31).replace(b"payload", b"PAYLOAD")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        warc.parse(pack.compress(raw) + pack.flush())


def test_nothing(spark):
    assert warc.report(pages(spark).limit(0)).count() == 0


def test_folders_and_read_tasks(spark, tmp_path):
    assert warc.shared_folder(spark, str(tmp_path)) == f"file:{tmp_path}"
    pages = spark.range(400).selectExpr("id as page_id", "concat('u', id) as url", "repeat(sha2(string(id), 512), 40) as html")
    index = warc.write(warc.decide(pages), warc.shared_folder(spark, str(tmp_path / "w")))
    out = warc.read(index, "", chunk=20_000)
    assert out.rdd.getNumPartitions() > 4 and out.count() == 400
    assert warc.read(index, "", chunk=20_000, most_tasks=2).rdd.getNumPartitions() <= 2
