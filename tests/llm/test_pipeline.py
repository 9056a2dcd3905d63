"""The pipeline against plain versions of its stages on a small table."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from tesserae.session import ready
from tests.llm.test_decontam import plain as contaminated
from tests.llm.test_ngram_join import plain as groups
from tests.llm.test_pii import spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gives, written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:5])


def test_stages_against_plain_versions(spark, stages):
    docs, good, single, clean, private, _ = stages
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    assert set(rows(good)) < set(rows(docs))
    assert sorted(i for i, _ in rows(single)) == sorted({c for _, _, c in groups(rows(good), 5, (4, 5))})
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in rows(clean)) == sorted(x[0] for x in contaminated(rows(single), bench, 13) if not x[5])
    before, after = dict(rows(clean)), dict(rows(private))
    assert set(before) == set(after)
    assert not any(spans(t) for t in after.values())
    assert any(spans(t) for t in before.values())


def test_packed(stages):
    private, packed = stages[4], stages[5]
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in private.collect()}
    used = Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 1


def test_run_is_its_stages(spark, stages):
    key = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[5])


def test_quality_stage_keeps_what_the_report_keeps(spark, stages):
    from tesserae.llm import quality
    from tests.llm.test_quality import plain as statistics

    report = quality.report(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert Counter(r.doc_id for r in report if r.kept) == Counter(r.doc_id for r in stages[1].collect())
    assert not any(statistics(r.text or "")[-1] for r in stages[1].collect())


def test_odd_rows_and_clashing_columns(spark, docs, tmp_path):
    """Nulls, empty and long texts, repeated rows, a null id, and columns that are called as operators' own."""
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, held = held, spark.read.parquet(str(tmp_path / name))
        assert held.count() <= before.count() and held.select("doc_id").subtract(before.select("doc_id")).count() == 0
    again = [r for r in docs.where("doc_id is null").limit(1).collect()]
    only = spark.createDataFrame(again * 2, docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, only, SF).collect()
    pieces = corpus_pipeline.STAGES[-1][1](spark, held, SF)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in held.collect()}


def test_empty_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_batches_end_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    texts = ready(spark).range(0, 400, 1, 1).selectExpr("repeat('x', 100000) as text")
    got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 40_000_000 and max(got) < 5_000_000
