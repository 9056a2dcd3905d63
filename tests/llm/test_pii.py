from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from tesserae.llm import pii

#: The contract's patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRICKY = "a@b.c+d@e.f.g 1.2.3.4.5 0001.2.3.255 256.1.1.1 1.2.3.0256 é😀 +1 (555) 123-4567- x@y 4111 1111 1111 1111 4111-1111-1111-1112 " + "9" * 50 + " 1.1.1.1. 4111111111111111 +49.30.1234567"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def spans(text: str) -> list[str]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15
            out += [f"{kind}:{m.start()}:{m.end()}"] * ok
    return out


def test_base_spans_against_plain_version(spark, docs, rows):
    extra = [(-11, TRICKY), (-12, " ".join(f"u{i}@x.org 10.0.{i % 256}.1" for i in range(1500))), (-13, "a@b" + ".c" * 20_000), (-14, "1" * 30_000 + ".")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = Counter()
    for i, t in [*rows, *extra]:
        found = spans(t or "")
        n = Counter(x.split(":")[0] for x in found)
        want[i, *(n[k] for k in PATTERNS), hashlib.sha256(",".join(found).encode()).hexdigest()] += 1
    got = pii.report(df).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    by_hash = {hashlib.sha256(",".join(spans(t or "")).encode()).hexdigest(): ",".join(spans(t or "")) for _, t in [*rows, *extra]}
    assert all(r.spans.startswith(by_hash[r.base_sha256]) for r in got)


WORD = re.compile(r"[^\W\d_]{3,}")


def entities(kind: str, m: str):
    digits = re.sub("[^0-9]", "", m)
    if kind == "email":
        return (kind, 0, m.lower()), (kind, 1, m.split("@", 1)[1].lower())
    if kind == "ip":
        return (kind, 0, m), (kind, 1, m.rpartition(".")[0])
    return (kind, 0, digits), (kind, 1, digits[:8] if kind == "card" else digits[:-4])


def terms(texts: list[str], least=3, reach=32, disclosure=0.85, full=0.02) -> dict[str, list[tuple]]:
    """The term spans (s, e, action, kind) of each text, term by term and entity by entity."""
    texts = sorted(set(texts))
    words = {t: [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(t)] for t in texts}
    n, df_t, df_c, near = len(texts), Counter(), Counter(), {}
    base = {}
    for t in texts:
        df_t.update({w for *_, w in words[t]})
        base[t] = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans(t))]
        df_c.update({c for k, s, e in base[t] for c in entities(k, t[s:e])})
    free = {t: [x for x in words[t] if not any(x[0] < e and x[1] > s for _, s, e in base[t])] for t in texts}
    for t in texts:
        near[t] = {(c, w) for k, s, e in base[t] for a, b, w in free[t] if a < e + reach and b > s - reach for c in entities(k, t[s:e])}
    n_ct = Counter(x for t in texts for x in near[t])
    strong = {}
    for (c, w), m in n_ct.items():
        ic, pmi = math.log(n / df_c[c]), math.log(n * m / (df_c[c] * (df_t[w] + 1 / m)))
        if ic > 0 and pmi >= disclosure * ic:
            strong[c, w] = pmi >= (1 - full) * ic
    out = {}
    for t in texts:
        risk: dict = {}
        for (c, w), gone in strong.items():
            if n_ct[c, w] >= least or (c, w) in near[t]:
                risk.setdefault(w, []).append((gone, c[0]))
        said = lambda w: ("remove" if any(g for g, _ in risk[w]) else "generalise", risk[w][0][1] if len({k for _, k in risk[w]}) == 1 else None)  # noqa: B023, E731
        out[t] = [(a, b, *said(w)) for a, b, w in free[t] if w in risk]
    return out


def test_terms_against_plain_version(spark, docs, rows):
    more = [(i, f"Dr Zorblax Quint answers at z@x.org or 10.1.2.{i} before noon{'abcdefgh'[i]}q") for i in range(6)] + [(9, "zorblax alone"), (10, "u@x.org 10.1.2.3 wuzzle")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*more, *more[:2]], "doc_id long, text string"))
    want = terms([t or "" for _, t in [*rows, *more]])
    got = pii.find_pii(df).select("doc_id", "terms").collect()
    text = {i: t or "" for i, t in [*more, *rows] if i is not None}
    told = {r.doc_id: [tuple(x) for x in r.terms] for r in got if r.doc_id is not None and r.doc_id > 10}
    assert told == {i: want[text[i]] for i in told} and sum(map(len, told.values())) > 50
    assert Counter(tuple(map(tuple, r.terms)) for r in got) == Counter(tuple(want[t or ""]) for _, t in [*rows, *more, *more[:2]])


def planted(spark):
    vary = lambda i: "lmnopqrst"[i % 9]
    held = [(i, f"alpha beta gamma{vary(i)}q contact bob@site.org with zorblatt {vary(i)}lm and {'uvwxyz'[i % 6]}zz more") for i in range(12)]
    plain = [(100 + i, f"alpha beta plain {vary(i)}lm text and more contact with") for i in range(200)]
    return spark.createDataFrame([*held, *plain, (400, "here Zorblatt alone zorblatt@q.org")], "doc_id long, text string")


def test_a_disclosing_term_is_found_and_common_words_stay(spark):
    df = planted(spark)
    assert [r.term for r in pii.disclosing_terms(df, pii.find_base(df)).collect()] == ["zorblatt"]
    rows = {r.doc_id: r for r in pii.report(df).collect()}
    assert rows[400].spans == "email:20:34,term:5:13" and rows[100].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[400] == "here [EMAIL TERM] alone [EMAIL]" and clean[100] == df.where("doc_id = 100").first().text


def test_copies_are_one_piece_of_evidence(spark):
    df = spark.createDataFrame([(i, "name wuzzle writes to eve@x.org each day") for i in range(50)] + [(100 + i, "other words here") for i in range(100)], "doc_id long, text string")
    assert pii.disclosing_terms(df, pii.find_base(df)).count() == 0


def test_copies_do_not_count_against_a_term(spark):
    texts = ["early one day wuzzle wrote eve@x.org from home", "the letter of wuzzle reached eve@x.org by noon", "nobody but wuzzle knows who eve@x.org may be"]
    held = [(i, texts[min(i, 2)]) for i in range(1_000)]
    plain = [(2_000 + i, f"other words here {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}") for i in range(300)]
    df = spark.createDataFrame([*held, *plain], "doc_id long, text string")
    assert [r.term for r in pii.disclosing_terms(df, pii.find_base(df)).collect()] == ["wuzzle"]


def test_a_fixed_phrase_in_different_texts_is_evidence(spark):
    word = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:05d}")
    body = lambda k: " ".join(word(20 * k + j) for j in range(20))
    signed = [(i, f"{body(i)} contact Dr Zorblax Quint at z@x.org {body(100 + i)}") for i in range(30)]
    plain = [(200 + i, f"contact at writes {body(400 + i)}") for i in range(300)]
    df = spark.createDataFrame([*signed, *plain], "doc_id long, text string")
    assert sorted(r.term for r in pii.disclosing_terms(df, pii.find_base(df)).collect()) == ["quint", "zorblax"]


def test_what_a_term_becomes(spark):
    word = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:05d}")
    plain = [(i, "then wrote and more long before nothing but other words once " + " ".join(word(30 * i + j) for j in range(30))) for i in range(300)]
    held = [(1_000 + i, f"{word(90_000 + i)} then Zorblax wrote z@x.org and more of it, long before {word(95_000 + i)} by Quint 10.1.2.3") for i in range(40)]
    seen = [(2_000 + i, f"quint and then and more of it wrote by {word(97_000 + i)}") for i in range(6)]
    one = [(3_000, "wuzzle 10.9.8.7 or +1 555 123 4567 then nothing but other words, and so on, and wuzzle once more")]
    df = spark.createDataFrame([*plain, *held, *seen, *one], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert got[1_000].startswith(f"{word(90_000)} then  wrote [EMAIL] and more of it, ") and got[1_000].endswith(" by [IP TERM] [IP]")
    assert got[2_000] == f"[IP TERM] and then and more of it wrote by {word(97_000)}" and got[5] == plain[5][1]
    assert got[3_000] == "[TERM] [IP] or [PHONE] then nothing but other words, and so on, and [TERM] once more"


def test_sanitise_keeps_columns_and_clean_texts(spark, docs, nothing):
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = spark.createDataFrame([(1, TRICKY), (2, None), (3, "+1 2.3.4.5 6")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(texts).collect()}
    assert got[1].startswith("[EMAIL][EMAIL] [IP].5 [IP] 256.1.1.1 1.2.3.0256 é😀 [PHONE]- x@y") and got[2] is None
    assert pii.sanitise(nothing).count() == pii.report(nothing).count() == 0
