from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tesserae.llm import ngram_join as nj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, n: int, threshold) -> list:
    p, q = threshold
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t or ""))
        k = min(n, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    lists: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            lists.setdefault(g, []).append(i)
    groups = nj.Union(len(rows))
    for i, s in enumerate(sets):
        common: dict = {}
        for g in s:
            for j in lists[g]:
                common[j] = common.get(j, 0) + 1
        for j, m in common.items():
            if j > i and q * m >= p * (len(s) + len(sets[j]) - m):
                groups.join(i, j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = groups.root(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(groups.root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def as_set(items) -> np.ndarray:
    return np.unique(np.array(sorted(items), np.uint64))


@pytest.mark.parametrize("threshold", [(9, 10), (4, 5), (1, 2), (1, 1)])
def test_similar_sets_share_a_part(threshold):
    rnd, (p, q) = random.Random(1), threshold
    tried = 0
    for _ in range(1500):
        x = {rnd.getrandbits(64) for _ in range(rnd.choice([1, 2, 3, 5, 8, 9, 10, 13, 20, 40, 100, 300]))}
        y = set(x)
        for g in rnd.sample(sorted(y), min(len(y) - 1, rnd.randint(0, max(1, len(y) * (q - p) // q)))):
            y.discard(g)
        y |= {rnd.getrandbits(64) for _ in range(rnd.randint(0, max(1, len(x) * (q - p) // q)))}
        if q * len(x & y) >= p * len(x | y):
            tried += 1
            assert set(nj.parts(as_set(x), threshold).tolist()) & set(nj.parts(as_set(y), threshold).tolist())
    assert tried > 50


@pytest.mark.parametrize("threshold", [(9, 10), (4, 5), (1, 2)])
def test_search_and_groups_against_all_pairs(threshold):
    rnd, (p, q) = random.Random(2), threshold
    for _ in range(80):
        base = [{rnd.getrandbits(64) for _ in range(rnd.choice([3, 10, 30]))} for _ in range(3)]
        sets = []
        for _ in range(rnd.randint(1, 25)):
            y = set(rnd.choice(base))
            for g in rnd.sample(sorted(y), rnd.randint(0, max(1, len(y) // 8))):
                y.discard(g)
            sets.append(y | {rnd.getrandbits(64) for _ in range(rnd.randint(0, 2))})
        arrays = [as_set(s) for s in sets]
        alike = lambda i, j: bool(sets[i]) and bool(sets[j]) and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j])  # noqa: B023, E731
        lists, want = nj.Lists(arrays), nj.Union(len(sets))
        for i in range(len(sets)):
            assert sorted(lists.search(arrays[i], threshold)) == [j for j in range(len(sets)) if alike(i, j)]
            for j in range(i):
                if alike(i, j):
                    want.join(i, j)
        got = nj.connect(arrays, threshold)
        assert all((got.root(i) == got.root(j)) == (want.root(i) == want.root(j)) for i in range(len(sets)) for j in range(i))


def near_copies(rnd: random.Random, count: int) -> list:
    words = [f"w{k}" for k in range(120)]
    out = []
    for i in range(count):
        own = list(words)
        for _ in range(rnd.randint(0, 2)):
            own[rnd.randrange(len(own))] = f"v{rnd.randrange(9999)}"
        out.append((1000 + i, " ".join(own)))
    return out


@pytest.mark.parametrize(("n", "threshold", "how"), [(3, (9, 10), {}), (5, (4, 5), {}), (3, (9, 10), {"block_size": 1500}), (2, (1, 2), {"block_size": 3000, "pivots": 1}), (3, (9, 10), {"block_rows": 3, "pivots": 0}), (2, (1, 2), {"block_rows": 4, "pivots": 1})])
def test_components_against_all_pairs(spark, docs, rows, n, threshold, how):
    extra = near_copies(random.Random(3), 60) + [(-31, "A b"), (-32, "a  B")]
    df = docs.select("doc_id", "text", "node", "part").unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.link_components(df, n, threshold, **how).collect()), key=repr)
    assert got == plain([*rows, *extra], n, threshold)


def test_deduplicate_keeps_one_of_each_group(spark, docs, rows):
    kept = nj.deduplicate(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    groups = plain([(i if i is not None else 10**9, t) for i, t in rows], 5, (4, 5))
    want = sorted({c for _, k, c in groups if k}) + [d for d, k, _ in groups if not k]
    assert sorted(10**9 if i is None else i for i in got) == sorted(want)


def test_different_texts_of_one_id_are_told_apart(spark):
    word = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(3, word(1)), (5, word(1) + " more"), (5, word(2)), (7, word(3)), (7, word(4)), (9, word(5)), (9, word(5)), (9, word(5) + " end"), (11, ""), (11, "")]
    got = [(r.doc_id, r.text) for r in nj.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    nines = [x for x in got if x[0] == 9]
    assert len(nines) == 1 and nines[0] in rows
    assert sorted(x for x in got if x[0] != 9) == sorted(x for x in rows if x[0] != 9 and x != (5, word(1) + " more"))


def test_visits_find_links_between_slices(spark, monkeypatch):
    rnd = random.Random(8)
    rows = []
    for g in range(40):  # chains: each text like the one before, the ends unlike
        words = [f"g{g}w{k}" for k in range(60)] if g % 2 else rows[0][1].split()[:30] + [f"g{g}w{k}" for k in range(60)] if rows else [f"c{k}" for k in range(60)]
        for i in range(5):
            rows.append((100 * g + i, " ".join(words)))
            words = list(words)
            for _ in range(2):
                words[rnd.randrange(len(words))] = f"v{rnd.randrange(99999)}"
    calls = []
    real = nj.visit
    monkeypatch.setattr(nj, "_part_rows", lambda *a, f=nj._part_rows: calls.append(1) or f(*a))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({"block_rows": 2, "pivots": 0}, {"block_rows": 3, "pivots": 1}):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.link_components(df, 3, (4, 5), **how).collect()), key=repr)
        assert got == plain(rows, 3, (4, 5))
    assert calls and real is nj.visit


def test_guests_are_searched_among_hosts(monkeypatch):
    rnd, made = random.Random(5), []

    class Seen(nj.Lists):
        def __init__(self, sets):
            super().__init__(sets)
            made.append((len(sets), self.owner.itemsize))

    monkeypatch.setattr(nj, "Lists", Seen)
    base = [{rnd.getrandbits(64) for _ in range(30)} for _ in range(4)]
    sets = [as_set(base[k % 4] | {rnd.getrandbits(64)}) for k in range(40)]
    sets = sets[:5] + [as_set({1, 2, 3})] + sets[5:]
    guests = list(range(6, len(sets)))
    got = nj.visit(sets, guests, (4, 5), nj.Union(len(sets)))
    want = nj.connect(sets, (4, 5))
    assert all((got.root(i) == got.root(j)) == (want.root(i) == want.root(j)) for i in range(len(sets)) for j in range(i))
    assert made[0] == (6, 4)


def test_nothing(nothing):
    assert nj.link_components(nothing).count() == nj.deduplicate(nothing).count() == 0
