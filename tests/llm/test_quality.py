from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from tesserae.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text: str):
    words = WORD.findall(text)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered, seen, dup = Counter(three), set(), set(), 0
    for i, t in enumerate(three):
        covered |= {i, i + 1, i + 2} if times[t] > 1 else set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_statistics_against_plain_version(spark, docs, rows):
    extra = [(-11, "a b c a b c a b c"), (-12, " x\ty\x0bz\n\n x\ty\x0bz\n"), (-13, "w " * 200), (-14, "l\nl\n l\nl"), (-15, "a b c d a b c d " * 40)]
    df = docs.select("doc_id", "text", "kept").unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = quality.report(df, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((i, *plain(t or "")) for i, t in [*rows, *extra])
    assert all(not (r.kept and r.base_failed) for r in got)


def test_a_planted_rule_is_learned(spark):
    n = 900
    good = [(i, "word " + " ".join(f"w{i}x{k}" for k in range(60 + i % 50)), 1) for i in range(n)]
    bad = [(n + i, " ".join(f"#w{i}&{k} *" for k in range(60 + i % 50)), 0) for i in range(n // 4)]
    rows = spark.createDataFrame([(i, t, q) for i, t, q in good + bad], "doc_id long, text string, quality int")
    judged = quality.judge(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))
    wrong = judged.join(rows.select("doc_id", "quality"), "doc_id").where(F.col("kept") != (F.col("quality") == 1)).count()
    assert wrong <= 0.05 * n // 4


def test_covering_grows_and_prunes():
    a, b = quality.Condition("f", True, 1.0, 0), quality.Condition("g", True, 1.0, 0)
    cells = [dict(f=1, g=1, bad=50, good=0, bad_p=25, good_p=0), dict(f=1, g=0, bad=0, good=40, bad_p=0, good_p=20), dict(f=0, g=1, bad=0, good=40, bad_p=0, good_p=20), dict(f=0, g=0, bad=0, good=80, bad_p=0, good_p=40)]
    got = quality.cover(cells, [a, b])
    assert len(got.rules) == 1 and set(got.rules[0]) == {a, b}
    noise = [dict(f=k % 2, g=0, bad=10, good=10, bad_p=5, good_p=5) for k in range(2)]
    assert quality.cover(noise, [a, b]).rules == []


def test_counts_of_rows_are_those_of_cells(spark):
    import random

    rnd = random.Random(5)
    rows = [(*[rnd.randint(0, 3) for _ in quality.FEATURES], rnd.random() < 0.3, rnd.random() < 0.6) for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} int" for f in quality.FEATURES) + ", _bad boolean, _grow boolean")
    cells = [dict(zip(quality.FEATURES, r, strict=False)) | {k: int((r[-2], r[-1]) == v) for k, v in {"bad": (True, True), "good": (False, True), "bad_p": (True, False), "good_p": (False, False)}.items()} for r in rows]
    conditions = [quality.Condition(f, above, 0.0, k) for f in quality.FEATURES for k in range(3) for above in (True, False)]
    a, b = quality.tally_rows(df), quality.tally_cells(cells)
    rules = [(conditions[0], conditions[9]), (conditions[4],)]
    assert a([], [], conditions) == b([], [], conditions) and a(rules, [conditions[-1]], conditions) == b(rules, [conditions[-1]], conditions)


def test_an_imprecise_start_doesn_t_end_the_list():
    f, g = quality.Condition("f", True, 1.0, 0), quality.Condition("g", True, 1.0, 0)
    # f gains most but is wrong on the labels to prune on; g is right
    cells = [dict(f=1, g=0, bad=60, good=10, bad_p=5, good_p=30), dict(f=0, g=1, bad=10, good=0, bad_p=12, good_p=0), dict(f=0, g=0, bad=5, good=200, bad_p=2, good_p=100)]
    assert quality.cover(cells, [f, g]).rules == [(g,)]


def test_rare_kinds_at_both_ends_are_found(spark):
    text = lambda k, word: " ".join(word(i) for i in range(60 + k % 40))
    good = [(k, text(k, lambda i: f"word{i}x{k}"), 1) for k in range(3_000)]
    tiny = [(5_000 + k, text(k, lambda i: "abcdefghijklmnopqrstuvwxyz"[i * (k + 3) % 26]), 0) for k in range(40)]
    marked = [(6_000 + k, text(k, lambda i: f"word{i}x{k}" + "#" * (i % 20 == 0)), 0) for k in range(40)]
    rows = spark.createDataFrame([*good, *tiny, *marked], "doc_id long, text string, quality int")
    judged = quality.judge(rows.select("doc_id", "text"), rows.select("doc_id", "quality")).join(rows.select("doc_id", "quality"), "doc_id")
    assert judged.where("kept and quality = 0").count() <= 4 and judged.where("not kept and quality = 1").count() <= 10


def test_without_labels_only_the_base_rules_reject(spark, docs, nothing):
    none = spark.createDataFrame([(1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, none)
    assert out.where("not base_failed and not kept").count() == 0
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()
    assert quality.report(nothing, none).count() == 0
