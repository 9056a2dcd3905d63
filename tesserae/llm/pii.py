"""Personal data: pattern spans, and terms that disclose a protected entity by corpus co-occurrence. DataFrame functions only.

A protected entity is the value of a pattern span (an address, a number) and, wider, the group it belongs to (a mail domain, a network,
a number range). Over all distinct texts, a term t that stands within `reach` characters of an entity c in n(c, t) of them discloses c
as far as PMI(c; t) = ln(N n(c, t) / (df(c) (df(t) + 1 / n(c, t)))) comes near the information of c itself, IC(c) = ln(N / df(c)). The
added part of an occurrence keeps a term that was seen but once or twice from counting as proof.

Terms that reach `disclosure` x IC(c) are generalised to the kind of what they disclose, or to a plain placeholder where they disclose several
kinds; terms that reach IC(c) but for `full` are removed. Evidence of `min_support` different texts or more holds everywhere in the
corpus; weaker evidence holds in the texts that it comes from, all occurrences of the term there. Copies of one text count
once, for a term or against it; near copies are different texts.

Defined results: a null text is empty; empty tables give empty tables; repeated rows are kept, each with its spans; a null
doc_id is an id of its own; texts are told apart by themselves, so neither ids nor other input columns matter. Running time is linear in the text for any input, since each
pattern starts at most once in a run of its characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tesserae.llm.common import BROADCAST_ROWS, again, at_most, join_hot, let, text_key, text_of, whole, written

#: The kinds and their patterns. Possessive, and anchored to where a run of characters starts (or the last match
#: ended): that changes no match and keeps a long run without "@" or "." from being tried from each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: What a generalised term becomes: one that discloses entities of one kind, of several kinds.
GENERAL = {"email": "[EMAIL TERM]", "ip": "[IP TERM]", "card": "[CARD TERM]", "phone": "[PHONE TERM]"}
TERM_AT_ALL = "[TERM]"
TERMS = "array<struct<s:int,e:int,action:string,kind:string>>"
TERM = r"\p{L}{3,}+"
#: Code points of a cell of text, in which words meet the spans near them.
_CELL = 512


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum of card numbers."""
    doubled = lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    each = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: doubled(F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return ~match.rlike(r"(?:^|\.)0*+(?:[1-9][0-9]{3}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), let(digits, _luhn)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def matches(text: Column, pattern: str, valid=None) -> Column:
    """array<struct<m, s, e>> of the pattern's leftmost matches that don't overlap, those that fail valid(match) dropped.

    A start is the length of all before it; sums are kept for blocks of matches, some cube root of their number long, so that many matches
    in one text stay cheap.
    """
    # split() gives what stands between the matches
    lengths = lambda found, gaps: F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    blocks = lambda n, size: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / size).cast("int")), lambda j: _sum(F.slice(n, j * size + 1, size)))
    before = lambda b: F.transform(b, lambda _, j: F.when(j == 0, 0).otherwise(_sum(F.slice(b, F.lit(1), F.greatest(j, F.lit(1))))))

    def located(found: Column, gaps: Column, size: Column) -> Column:
        def at(n: Column, base: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                rest = F.when(i % size == 0, 0).otherwise(_sum(F.slice(n, i - i % size + 1, F.greatest(i % size, F.lit(1)))))
                start = F.get(base, F.floor(i / size).cast("int")) + rest + F.length(F.get(gaps, i))
                return F.when(valid(m) if valid else F.lit(True), F.struct(m.alias("m"), start.alias("s"), (start + F.length(m)).alias("e")))

            return F.filter(F.transform(found, one), lambda x: x.isNotNull())

        return let(lengths(found, gaps), lambda n: let(let(blocks(n, size), before), lambda base: at(n, base)))

    empty = F.array().cast("array<struct<m:string,s:int,e:int>>")
    some = lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: let(F.ceil(F.cbrt(2 * F.size(found))).cast("int"), lambda size: located(found, gaps, size)))).otherwise(empty)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def _named(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["m"].alias("m"), x["s"].alias("s"), x["e"].alias("e"))


def base_spans(text: Column) -> Column:
    """array<struct<m, s, e, kind>> by kind as PATTERNS lists them, then start; code points, end exclusive."""
    empty = F.array().cast("array<struct<kind:string,m:string,s:int,e:int>>")
    parts = []
    for kind, pattern in PATTERNS.items():
        found = matches(text, pattern, lambda m, k=kind: _valid(k, m))
        named = F.transform(found, _named(kind))
        need = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        parts.append(F.when(need & (text.rlike("[0-9]") if kind != "email" else F.lit(True)), named).otherwise(empty))
    return F.concat(*parts)


def _entities(span: Column) -> Column:
    """The protected entities of a span: its value (addresses without case, digits without separators) and the group of that."""
    kind, m = span["kind"], span["m"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    value = F.when(kind == "email", F.lower(m)).when(kind == "ip", m).otherwise(digits)
    group = F.when(kind == "email", F.lower(F.regexp_extract(m, "@(.*)", 1))).when(kind == "ip", F.regexp_extract(m, r"(.*)\.", 1))
    group = group.when(kind == "card", F.substring(digits, 1, 8)).otherwise(F.regexp_extract(digits, "^(.*).{4}$", 1))
    return F.array(F.xxhash64(kind, F.lit(0), value), F.xxhash64(kind, F.lit(1), group))


def find_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' doc_id, `_h` (text_key), `_text`, `_base` (spans)."""
    return docs.select(F.col("doc_id"), text_of(text).alias("_text")).select("doc_id", text_key(F.col("_text")).alias("_h"), "_text", base_spans(F.col("_text")).alias("_base"))


def _distinct_terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _cells(lo: Column, hi: Column) -> Column:
    """The cells that [lo, hi) touches, a row each."""
    return F.explode(F.sequence(F.floor(F.greatest(lo, F.lit(0)) / _CELL), F.floor((hi - 1) / _CELL))).alias("_cell")


def _words(texts: DataFrame) -> DataFrame:
    """`_h`, term, s, e of each word of texts (`_h`, `_text`)."""
    return texts.select("_h", F.explode(matches(F.col("_text"), TERM)).alias("x")).select("_h", F.lower("x.m").alias("term"), F.col("x.s").alias("s"), F.col("x.e").alias("e"))


def _spans(held: DataFrame, reach: int = 0) -> DataFrame:
    """`_h`, kind, c (entities), bs, be, by the cells within reach, of each base span."""
    one = held.select("_h", F.explode("_base").alias("b")).select("_h", "b.kind", _entities(F.col("b")).alias("c"), F.col("b.s").alias("bs"), F.col("b.e").alias("be"))
    return one.select("*", _cells(F.col("bs") - reach, F.col("be") + reach))


def _held(found: DataFrame) -> DataFrame:
    """The different texts with spans: `_h`, `_text`, `_base`."""
    return found.where(F.size("_base") > 0).select("_h", "_text", "_base").dropDuplicates(["_h"])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if at_most(df) else df


def near_terms(held: DataFrame, reach: int) -> DataFrame:
    """`_h`, c, kind, term: each term that stands within reach of an entity and in no base span, once a text."""
    spans = written(_spans(held, reach), "spans")
    words = _words(held).select("*", _cells(F.col("s"), F.col("e")))
    beside = words.join(_small(spans), ["_h", "_cell"]).where((F.col("s") < F.col("be") + reach) & (F.col("e") > F.col("bs") - reach))
    inside = (F.col("s") < F.col("be")) & (F.col("e") > F.col("bs"))
    free = beside.groupBy("_h", "s", "term").agg(F.max(inside).alias("_in"), F.collect_set(F.struct("kind", "c")).alias("_c")).where(~F.col("_in"))
    return free.select("_h", "term", F.explode("_c").alias("_c")).select("_h", F.explode("_c.c").alias("c"), "_c.kind", "term").distinct()


def disclosures(docs: DataFrame, found: DataFrame, held: DataFrame, near: DataFrame, disclosure: float = 0.85, full: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """c, term, kind, n_ct and action of each pair in which the term discloses the entity; `_h` and term of each text that holds a term
    that could.

    found: find_base() of docs, with `_text` null where there is no span; held, near: its _held() and near_terms().
    """
    n = float(max(1, found.select("_h").distinct().count()))
    df_c = held.select("_h", F.explode(F.array_distinct(F.flatten(F.transform("_base", _entities)))).alias("c")).groupBy("c").agg(F.count("*").alias("n_c"))
    support = near.groupBy("c", "term").agg(F.count("*").alias("n_ct"), F.first("kind").alias("kind"))
    likely = join_hot(support, df_c, ["c"], "inner", salt_by=["term"]).where(F.col("n_c") < n)
    ic = F.log(F.lit(n) / F.col("n_c"))
    pmi = lambda n_t: F.log(F.lit(n) * F.col("n_ct") / (F.col("n_c") * (F.col(n_t) + 1 / F.col("n_ct"))))
    # a term's texts among those with personal data bound all its texts from below, and so its PMI from above
    among = held.select(F.explode(_distinct_terms(F.col("_text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_held"))
    candidates = written(join_hot(likely, among, ["term"], "inner", salt_by=["c"]).where(pmi("n_held") >= disclosure * ic).drop("n_held"), "candidates")
    terms = candidates.select("term").distinct()
    every = docs.select(text_key(text_of()).alias("_h"), F.explode(_distinct_terms(text_of())).alias("term"))
    texts_of = written(join_hot(every, terms, ["term"], "left_semi", salt_by=["_h"]).distinct(), "texts_of")
    df_t = texts_of.groupBy("term").agg(F.count("*").alias("n_t"))
    strong = candidates.join(df_t, "term").where(pmi("n_t") >= disclosure * ic)
    return strong.select("c", "term", "kind", "n_ct", F.when(pmi("n_t") >= (1 - full) * ic, "remove").otherwise("generalise").alias("action")), texts_of


def _strongest(rows: DataFrame, *keys: str) -> DataFrame:
    """One action a key: to remove, if any says so; kind, if all disclose the same."""
    return rows.groupBy(*keys).agg(F.max("action").alias("action"), F.when(F.min("kind") == F.max("kind"), F.max("kind")).alias("kind"))


def disclosing_terms(docs: DataFrame, found: DataFrame, min_support: int = 3, reach: int = 32, **how) -> DataFrame:
    """term, action, kind of the terms that disclose some entity wherever they stand."""
    held = written(_held(found), "held")
    strong, _ = disclosures(docs, found, held, written(near_terms(held, reach), "near"), **how)
    return _strongest(strong.where(F.col("n_ct") >= min_support), "term")


def find_pii(docs: DataFrame, min_support: int = 3, reach: int = 32, **how) -> DataFrame:
    """doc_id, `_h`, base (spans by pattern), terms (TERMS, by start): one row for each row of docs."""
    slim = F.when(F.size("_base") > 0, F.col("_text"))
    found = written(find_base(docs).withColumn("_text", slim), "pii")
    held = written(_held(found), "held")
    near = written(near_terms(held, reach), "near")
    strong, texts_of = disclosures(docs, found, held, near, **how)
    strong = written(strong, "disclosing")
    risk = near.join(_small(strong.where(F.col("n_ct") < min_support).drop("kind")), ["c", "term"]).select("_h", "term", "action", "kind")
    texts = held.select("_h", "_text")
    wide = written(_strongest(strong.where(F.col("n_ct") >= min_support), "term"), "wide")
    if not at_most(wide, 0):
        keyed = docs.select(text_key(text_of()).alias("_h"), text_of().alias("_text"))
        hits = join_hot(texts_of, wide, ["term"], "inner", salt_by=["_h"]).select("_h", "term", "action", "kind")
        risk = written(risk.unionAll(hits), "risks")
        others = written(risk.select("_h").distinct().join(held.select("_h"), "_h", "left_anti"), "others")
        texts = texts.unionAll(join_hot(keyed, others, ["_h"], "left_semi", salt_by=["_text"]).dropDuplicates(["_h"]))
    risk = written(_strongest(risk, "_h", "term"), "risk")
    at = written(join_hot(_words(texts), risk, ["_h", "term"], "inner", salt_by=["s"]).select("_h", "s", "e", "action", "kind"), "places")
    spans = _spans(held).select("_h", "_cell", "bs", "be")
    inside = at.select("_h", "s", "e", _cells(F.col("s"), F.col("e"))).join(spans, ["_h", "_cell"]).where((F.col("s") < F.col("be")) & (F.col("e") > F.col("bs")))
    free = at.join(inside.select("_h", "s").distinct(), ["_h", "s"], "left_anti")
    by_text = free.groupBy("_h").agg(F.sort_array(F.collect_list(F.struct("s", "e", "action", "kind"))).alias("terms"))
    return join_hot(found, by_text, ["_h"], salt_by=["doc_id"]).select("doc_id", "_h", F.col("_base").alias("base"), F.coalesce("terms", F.array().cast(TERMS)).alias("terms"))


def _as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, **how) -> DataFrame:
    """The digest of find_pii(): counts by kind, hash of the base spans, all spans, and how many terms were removed and generalised."""
    out = find_pii(docs, **how)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    added = F.transform("terms", lambda x: F.struct(F.lit("term").alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    plain = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    acted = lambda a, name: F.size(F.filter("terms", lambda x: x["action"] == a)).cast("long").alias(name)
    digest = F.sha2(_as_text(F.col("base")), 256).alias("base_sha256")
    return out.select("doc_id", *map(count, PATTERNS), digest, _as_text(F.concat(plain, added)).alias("spans"), acted("remove", "n_removed"), acted("generalise", "n_generalised"))


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """docs with personal data replaced in text: placeholders for base spans and generalised terms, nothing for removed ones.

    Spans that overlap are replaced as one, by the placeholder of the first. A null text stays null.
    """
    says = lambda names: F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    general = lambda x: F.when(x["action"] == "remove", "").otherwise(F.coalesce(F.element_at(says(GENERAL), F.coalesce(x["kind"], F.lit(""))), F.lit(TERM_AT_ALL)))
    spans = F.concat(
        F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(says(PLACEHOLDER), x["kind"]).alias("by"))),
        F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), general(x).alias("by"))),
    )
    found = find_pii(docs, **how).select("_h", F.sort_array(spans).alias("_spans")).where(F.size("_spans") > 0).groupBy("_h").agg(F.first("_spans").alias("_spans"))
    found = written(found, "replaced")
    small = (found.agg(F.sum(F.size("_spans") + 1)).first()[0] or 0) <= 2 * BROADCAST_ROWS
    keyed = whole(docs, text_key(text_of()).alias("_h"), F.col("text"), F.monotonically_increasing_id().alias("_i"))
    joined = join_hot(keyed, found, ["_h"], salt_by=["_i"], small=small)

    def rewritten(sp: Column) -> Column:
        reach = lambda i: F.when(i == 0, 0).otherwise(F.array_max(F.transform(F.slice(sp, F.lit(1), F.greatest(i, F.lit(1))), lambda x: x["e"])))
        piece = lambda x, i: let(reach(i), lambda r: F.when(x["s"] >= r, F.concat(F.substring(F.col("text"), r + 1, x["s"] - r), x["by"])).otherwise(""))
        return F.concat(F.array_join(F.transform(sp, piece), ""), let(reach(F.size(sp)), lambda r: F.substring(F.col("text"), r + 1, F.length("text"))))

    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(rewritten(F.col("_spans")))
    return again(joined, docs.columns, text=text)
