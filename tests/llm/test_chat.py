from __future__ import annotations

import hashlib
import random

import pytest

from tesserae.llm import chat, queries

said = "\\### Assistant: </turn> ok"


def test_round_trip():
    rnd = random.Random(1)
    bits = ["### ", "</turn>", "\n", "\\", ":", " ", "a", "#", "<", "/turn>", "assistant", ": ", "é"]
    template = chat.Template()
    for _ in range(500):
        turns = [{"role": rnd.choice(["user", "assistant", "a: b\\", "", "### x"]), "text": "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))} for _ in range(rnd.randint(0, 5))]
        parts = list(template.render(iter(turns)))
        assert len(parts) == len(turns)
        assert list(chat.read("".join(p.text for p in parts))) == [(t["role"], t["text"]) for t in turns]
        loss = "".join(chat.unescape(p.text[a:b]) for p in parts for a, b in p.loss)
        assert loss == "".join(t["text"] for t in turns if t["role"] == "assistant")


def test_constants_are_folded():
    tree = chat.Template("{% if 'a' + 'b' == 'ab' and not false %}x{{ 'y' | upper }}{% else %}q{% endif %}").tree
    assert tree == (chat.Text(chat.Const("xY")),)


def test_language():
    source = "{% set who = 'Bot' %}{% for m in messages %}{% if loop.first %}^{% endif %}{% if m.role == 'user' %}U{% elif m['role'] == 'x' %}X{% else %}{{ who }}{% endif %}{% if loop.last %}${% endif %}{% endfor %}!"
    out = "".join(s.text for s in chat.Template(source).render(iter([{"role": r, "text": ""} for r in ("user", "x", "z")])))
    assert out == "^UXBot$!"


@pytest.mark.parametrize("bad", ["{% for m in messages %}", "{{ m. }}", "{{ 'a' | evil }}", "{% endif %}", "{{ 1 + }}", "{% if %}{% endif %}"])
def test_bad_templates(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad)


def test_the_sandbox_holds():
    for source in ("{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{{ nothing }}", "{% for m in messages %}{{ m.role + 1 }}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            list(chat.Template(source).render(iter([{"role": "u", "text": ""}])))


def test_query_against_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    want: dict = {-7: [("user", said), ("assistant", said)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = queries.op10_chat(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))


def test_nulls_ties_and_nothing(spark):
    rows = [(None, 1, "user", None), (1, 1, None, "b"), (1, 1, None, "a"), (1, 0, "assistant", "z" * 100_000), (1, None, "user", "first"), (1, 1, None, "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as loss")
    parts = chat.format_conversations(df).where("conv_id = 1").orderBy("part").collect()
    assert [list(chat.read(p.text))[0] for p in parts] == [("user", "first"), ("assistant", "z" * 100_000), ("", "a"), ("", "a"), ("", "b")]
    assert {r.conv_id: r.n_turns for r in chat.report(df).collect()} == {None: 1, 1: 5}
    assert chat.report(df.limit(0)).count() == 0
