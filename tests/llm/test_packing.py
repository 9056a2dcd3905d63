from __future__ import annotations

import itertools
import random
import struct
import zlib
from collections import Counter

from tesserae.llm import packing
from tesserae.llm.queries import word_tokenizer

MIXED = [(-21, "a..b, c.,. İΣ Σ. ΑΣ, don't x's. ÀÉ. é. \xa0z\x1cq w"), (-22, "<|endoftext|> y"), (-24, "A<|startoftext|>B <|ENDOFTEXT|> <|endoftext|>z"), (-23, "K Å é ﬁ ½ ٣ 你好, ok."), (7, "again")]


def fewest(items: list[int], capacity: int) -> int:
    best = len(items)

    def go(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rnd = random.Random(1)
    for _ in range(200):
        capacity = rnd.choice([10, 20, 50])
        items = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(0, 11))), reverse=True)
        got = packing.pack_histogram(Counter(items), capacity)
        assert Counter(x for p, n in got for x in p for _ in range(n)) == Counter(items)
        assert all(sum(p) <= capacity for p, _ in got)
        assert sum(n for _, n in got) == (fewest(items, capacity) if items else 0)


def test_many_pieces_come_near_the_lower_bound():
    rnd = random.Random(2)
    hist = Counter(max(1, min(2048, int(rnd.lognormvariate(6.8, 0.8)))) for _ in range(100_000))
    bins = sum(n for _, n in packing.pack_histogram(hist, 2048))
    assert bins <= 1.01 * -(-sum(x * n for x, n in hist.items()) // 2048)


def test_dominated_fillings_are_left_out():
    assert list(packing.completions(10, {10: 1, 6: 1, 4: 1})) == [(10,)]
    found = list(packing.completions(10, {7: 1, 2: 2, 1: 1}))
    assert found[0] == (7, 2, 1) and not any(packing._dominates(a, b) for k, b in enumerate(found) for a in found[:k])


def test_all_undominated_fillings_are_enumerated():
    rnd = random.Random(4)
    for _ in range(150):
        room, items = rnd.randint(1, 14), [rnd.randint(1, 12) for _ in range(rnd.randint(0, 7))]
        able = {f for r in range(len(items) + 1) for f in itertools.combinations(sorted(items, reverse=True), r) if sum(f) <= room}
        want = {f for f in able if not any(g != f and packing._dominates(g, f) for g in able)}
        assert set(packing.completions(room, Counter(items))) == want


def test_search_gains_where_best_fit_isn_t_enough():
    hist = Counter({6: 2, 5: 2, 4: 2, 3: 4, 2: 2})  # 46 tokens: 4 bins of 12
    rnd = random.Random(7)
    harder = Counter(rnd.randint(500, 1200) for _ in range(300))
    for counts, capacity, most in ((hist, 12, 4), (harder, 2048, 127)):
        first, found = packing._best_fit(counts, capacity), packing.pack_histogram(counts, capacity)
        assert sum(n for _, n in found) <= most and sum(n for _, n in found) <= sum(n for _, n in first)
        assert packing.lower_bound(counts, capacity) <= sum(n for _, n in found)
        assert Counter({x: sum(p.count(x) * n for p, n in found) for x in counts}) == counts
    assert sum(n for _, n in packing._best_fit(harder, 2048)) > 127


def test_lower_bound():
    rnd = random.Random(6)
    for _ in range(150):
        capacity = rnd.choice([10, 21])
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))]
        assert -(-sum(items) // capacity) <= packing.lower_bound(Counter(items), capacity) <= fewest(sorted(items, reverse=True), capacity)
    assert packing.lower_bound({6: 3, 5: 3}, 10) == 5


def test_a_length_of_many_pieces_is_numbered_in_parts(spark):
    pieces = spark.range(500).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id < 300, 7L, 3L + id % 3) as length", "id as ids_crc32")
    got = packing.place(pieces, 10, run=20).collect()
    seen: dict = {}
    for r in got:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seen.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 10
    assert len(got) == 500 and len(seen) == got[0].n_sequences >= got[0].least_sequences


def test_round_trip_against_the_tokenizer(spark, docs, rows):
    from tokenizers import Tokenizer

    df = docs.select("doc_id", "text", "length").unionByName(spark.createDataFrame(MIXED, "doc_id long, text string"), allowMissingColumns=True)
    got = packing.pack(df, word_tokenizer(), 512).collect()
    t = Tokenizer.from_file(word_tokenizer())
    want = Counter()
    for i, text in [*rows, *MIXED]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 512):
            part = ids[k : k + 512]
            want[i, k // 512, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places: dict = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert len(places) <= 1.01 * sum(r.length for r in got) / 512 + 1


def test_words_against_the_tokenizer():
    rnd = random.Random(3)
    t = packing.Tokens(word_tokenizer())
    chars = [chr(i) for i in range(32, 256)] + list(" \n\t..,,abcdeéÀß'sİΣς١Ａé̈\xa0\x85\x1c 😀K") * 6
    for _ in range(3000):
        text = "".join(rnd.choice(chars) for _ in range(rnd.randint(0, 30)))
        ids = t.tokenizer.encode(text, add_special_tokens=False).ids
        assert t(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_few_ids_are_kept():
    rnd = random.Random(4)
    t = packing.Tokens(word_tokenizer())
    for _ in range(20):
        text = " ".join("".join(rnd.choices("abcdefghij", k=9)) for _ in range(10_000))
        ids = t(text)
        assert len(t.ids) <= 120_010
    assert ids == t._whole(text)


def test_special_strings_and_other_files():
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "A<|startoftext|>B <|ENDOFTEXT|>", "The  end. It's 12", ""]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = word_tokenizer().replace("word_bpe_49k.json", name)
        for plain in (False, True):
            t, own = Tokenizer.from_file(path), packing.Tokens(path, plain)
            t.encode_special_tokens = plain
            assert own.by_word == name.startswith("word")
            for x in texts:
                ids = t.encode(x, add_special_tokens=False).ids
                assert own(x) == struct.pack(f"<{len(ids)}I", *ids)


def test_ids_and_nothing(docs, nothing):
    with_ids = packing.pack(docs.limit(3), word_tokenizer(), 64, with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in with_ids)
    assert packing.pack(nothing, word_tokenizer()).count() == 0
