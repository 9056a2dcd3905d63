from __future__ import annotations

import hashlib
import re

import pytest

from tesserae.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [(1000, "short item ö"), (1001, None), (1002, " -- "), (None, "a a"), (1000, "short item ö"), (1003, "it's")]


def low(text) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, width):
    windows: dict = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add("" if i is None else str(i))
    sizes, out = {len(x) for x in windows}, []
    for d, t in docs:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        near, words = set(), set(w)
        for x, own in windows.items():
            if own - near and words.issuperset(x):
                near |= own if any(set(x) <= set(w[k : k + 24]) for k in range(len(w)) if w[k] in x) else set()
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w), len(near)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def cases(spark, docs, rows):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    long = " ".join(r.text for r in bench.limit(5).collect())
    extra = [(-41, "Short item Ö!! short item ö"), (None, "short ITEM ö"), (-42, "a a a a a"), (-43, "filler " * 300 + long), (-44, long)]
    df = docs.select("doc_id", "text", "n_words").unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    items = bench.unionByName(spark.createDataFrame(ITEMS, "item_id long, text string"))
    return df, [*rows, *extra], items, [(r.item_id, r.text) for r in items.collect()]


@pytest.mark.parametrize(("width", "how"), [(13, {}), (4, {}), (13, {"block_windows": 300})])
def test_against_plain_version(cases, width, how):
    df, rows, items, bench = cases
    got = sorted((tuple(r) for r in decontam.report(df, items, width=width, **how).collect()), key=repr)
    assert got == plain(rows, bench, width)


def test_index_without_a_vocabulary_gives_the_same(cases, monkeypatch):
    df, rows, items, bench = cases
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert sorted((tuple(r) for r in decontam.report(df, items).collect()), key=repr) == plain(rows, bench, 13)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "delta x gamma y beta z alpha"), (2, "alpha " + "q " * 50 + "beta gamma delta"), (3, "alpha beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near) for r in decontam.report(docs, items).collect()}
    assert got == {1: (0, 1), 2: (0, 0), 3: (1, 1)}


def test_long_items_and_the_ends_of_documents(spark):
    words = [f"w{k}" for k in range(60)]
    items = [(1, " ".join(words)), (2, "x y z")]
    docs = [(1, " ".join(words[20:45])), (2, "z"), (3, "y x"), (4, "z q y " + "q " * 21 + "x"), (5, "z q y " + "q " * 20 + "x")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontam.report(df, bench).collect()), key=repr)
    assert got == plain(docs, items, 13) and {r[0]: r[6] for r in got} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}
    pieces = decontam._pieces(bench, 13, most=10).collect()
    windows = {tuple(w[k : k + 13]) for r in pieces for w in [r.text.decode().split()] for k in range(max(1, len(w) - 12))}
    assert windows == {tuple(words[k : k + 13]) for k in range(48)} | {("x", "y", "z")} and max(r.windows for r in pieces) <= 10


def test_decontaminate(cases, nothing):
    df, rows, items, bench = cases
    out = decontam.decontaminate(df, items)
    assert out.columns == df.columns and out.count() == sum(not x[5] for x in plain(rows, bench, 13))
    assert decontam.report(nothing, items).count() == 0
    assert decontam.report(df, items.limit(0)).where("n_hit > 0").count() == 0
