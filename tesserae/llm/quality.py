"""Quality rules: a decision list learned by sequential covering from labelled statistics. DataFrame functions only.

statistics() measures every text. learn() tries thresholds where the classes end: between quantiles of the bad and of the good labelled
rows, dense at both ends. Each rule is a conjunction of thresholds: grown by information gain on two thirds of the labels, pruned on the
other third, and kept if it is right in at least `precision` of the latter and, by Laplace's estimate, of all; if not, the next best start is grown. A step of growth is one
aggregate over all labelled rows that the rules so far leave, counts by feature and bin; nothing else reaches the driver, so the
number of labels doesn't matter. The list becomes one ordered conditional expression.

Defined results: a null text has no words and fails the base rules; repeated rows are each judged; without labels, or where no
rule is precise enough, the list is empty and only the base rules reject; columns of the input other than doc_id and text stay
as they are, and a statistic replaces an input column of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tesserae.llm.common import WHITE, again, id_key, let, text_of, whole, written

FEATURES = ("symbols_per_word", "upper_share", "repeat_share", "dup_line_share", "mean_word", "n_words_f")
#: Shares of the labelled rows, bad ones and good ones, between whose values thresholds are tried.
CUTS = (0.0, 0.002, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 0.998, 1.0)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: Column) -> Column:
    """Words in windows of three that occur twice or more: windows sorted by hash, the places of equal ones joined again."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    twice = lambda s: F.transform(F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"])
    covered = lambda at: F.aggregate(F.transform(at, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(at, k - 1)))), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(words) < 4, 0).otherwise(let(F.sort_array(windows), lambda s: let(F.sort_array(twice(s)), covered)))


def statistics(docs: DataFrame) -> DataFrame:
    """docs with BASE (long) and FEATURES (double)."""
    text = text_of()
    words = F.filter(F.split(text, WHITE, -1), lambda w: w != "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeated(w).cast("long").alias("repeat")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    kept = [c for c in docs.columns if c not in (*BASE, *FEATURES, "_w", "_l", "_s", "_u")]
    out = docs.select(*kept, of_words.alias("_w"), of_lines.alias("_l"), F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("_s"), F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("_u"))
    share = lambda a, b: (a / F.greatest(b, F.lit(1))).cast("double")
    return out.select(
        *kept, F.col("_w.n").alias("n_words"), F.col("_w.chars").alias("word_chars"), F.col("_s").alias("n_symbols"), F.col("_l.dup").alias("n_dup_lines"), F.col("_w.repeat").alias("n_repeat_words"),
        share(F.col("_s"), F.col("_w.n")).alias("symbols_per_word"), share(F.col("_u"), F.col("_w.chars")).alias("upper_share"), share(F.col("_w.repeat"), F.col("_w.n")).alias("repeat_share"),
        share(F.col("_l.dup"), F.col("_l.n")).alias("dup_line_share"), share(F.col("_w.chars"), F.col("_w.n")).alias("mean_word"), F.col("_w.n").cast("double").alias("n_words_f"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float
    bin: int

    def holds(self, bins: dict[str, int]) -> bool:
        return (bins[self.feature] > self.bin) == self.above

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


@dataclass
class DecisionList:
    """Rules in order; a text that none covers is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rejected_by(self) -> Column:
        """Number of the first rule that holds, from 1; 0 if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            holds = rule[0].column()
            for c in rule[1:]:
                holds = holds & c.column()
            out = F.when(holds, k) if out is None else out.when(holds, k)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        return "; ".join(" and ".join(map(str, r)) for r in self.rules) or "keep all"


Counts = tuple[int, int, int, int]  # bad and good labels, to grow and to prune on
Tally = Callable[[list, list, list], tuple[Counts, list[Counts]]]


def tally_cells(cells: list[dict]) -> Tally:
    """Counts over cells {feature: bin, bad, good, bad_p, good_p} that are at hand."""

    def tally(rules: list, rule: list, conditions: list[Condition]) -> tuple[Counts, list[Counts]]:
        left = [c for c in cells if not any(all(x.holds(c) for x in r) for r in rules) and all(x.holds(c) for x in rule)]
        count = lambda own: tuple(sum(c[k] for c in own) for k in ("bad", "good", "bad_p", "good_p"))
        return count(left), [count([c for c in left if x.holds(c)]) for x in conditions]

    return tally


def tally_rows(rows: DataFrame) -> Tally:
    """Counts over rows: the features' bins, `_bad` and `_grow`. One aggregate each: counts by feature and bin."""
    n = lambda x, name: F.sum(x.cast("long")).alias(name)
    bad, grow = F.col("_bad"), F.col("_grow")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f).alias("b")) for k, f in enumerate(FEATURES)])).alias("x")
    holds = lambda c: F.col(c.feature) > c.bin if c.above else F.col(c.feature) <= c.bin
    every = lambda rule: reduce(and_, map(holds, rule), F.lit(True))

    def tally(rules: list, rule: list, conditions: list[Condition]) -> tuple[Counts, list[Counts]]:
        left = rows.where(reduce(and_, [~every(r) for r in rules], every(rule))).select(each, "_bad", "_grow")
        by_bin = left.groupBy("x.f", "x.b").agg(n(bad & grow, "bad"), n(~bad & grow, "good"), n(bad & ~grow, "bad_p"), n(~bad & ~grow, "good_p")).collect()
        count = lambda f, own: tuple(sum(r[k] for r in by_bin if r["f"] == f and own(r["b"])) for k in ("bad", "good", "bad_p", "good_p"))
        return count(0, lambda b: True), [count(FEATURES.index(c.feature), lambda b, c=c: (b > c.bin) == c.above) for c in conditions]

    return tally


def cover(cells: list[dict] | Tally, conditions: list[Condition], max_rules: int = 32, max_terms: int = 3, precision: float = 0.9, least: int = 5, tries: int = 8) -> DecisionList:
    """Sequential covering. Ends when fewer than `least` bad labels are left or none of the `tries` best starts grows into a precise rule."""
    out, tally = DecisionList(), cells if callable(cells) else tally_cells(cells)

    def ranked(whole: Counts, counts: list[Counts]) -> list[tuple[Condition, Counts]]:
        """Conditions that gain, the best first."""
        p0, n0 = whole[:2]
        gain = lambda p, n: p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
        scored = [(gain(c[0], c[1]), -k) for k, c in enumerate(counts) if c[0] >= least and c[:2] != (p0, n0)]
        return [(conditions[-k], counts[-k]) for g, k in sorted(scored, reverse=True) if g > 0]

    right = lambda c: (c[2] + 1) / (c[2] + c[3] + 2)
    # a rare kind has few labels to prune on: these must agree, and all labels together be enough
    precise = lambda c: c[2] > 0 and c[2] >= precision * (c[2] + c[3]) and c[0] + c[2] + 1 >= precision * (sum(c) + 2)
    while len(out.rules) < max_rules:
        whole, counts = tally(out.rules, [], conditions)
        if whole[0] < least or not whole[1]:
            break
        for start in ranked(whole, counts)[:tries]:
            rule = [start]  # each condition with the counts of the rule up to it
            while len(rule) < max_terms and rule[-1][1][1]:
                better = ranked(*tally(out.rules, [c for c, _ in rule], conditions))
                if not better:
                    break
                rule.append(better[0])
            while len(rule) > 1 and right(rule[-2][1]) >= right(rule[-1][1]):
                rule.pop()
            if precise(rule[-1][1]):
                out.rules.append(tuple(c for c, _ in rule))
                break
        else:
            break
    return out


def _between(values: list[float]) -> list[float]:
    """Thresholds in the middle between neighbouring values: as far as can be from what either side holds."""
    return [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality", bad: int = 0, **how) -> DecisionList:
    """Learn from all rows of stats that have a label."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), (F.col(label) == bad).alias("_bad"))
    rows = written(stats.select(id_key().alias("_id"), *FEATURES).join(known, "_id"), "labelled")
    ends = lambda f: [F.percentile_approx(F.when(F.col("_bad") == b, F.col(f)), list(CUTS), 10_000).alias(f"{f}_{b}") for b in (True, False)]
    found = rows.agg(*[c for f in FEATURES for c in ends(f)]).first()
    cuts = {f: _between(sorted({*(found[f"{f}_True"] or []), *(found[f"{f}_False"] or [])})) for f in FEATURES}
    bins = []
    for f in FEATURES:
        code = F.lit(0)
        for c in cuts[f]:
            code = code + F.when(F.col(f) > c, 1).otherwise(0)
        bins.append(code.cast("byte").alias(f))
    binned = written(rows.select(*bins, "_bad", (F.pmod(F.xxhash64("_id", F.lit(4)), F.lit(3)) != 0).alias("_grow")), "binned")
    conditions = [Condition(f, above, c, k) for f in FEATURES for k, c in enumerate(cuts[f]) for above in (True, False)]
    return cover(tally_rows(binned), conditions, **how)


def judge(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs without text, with the statistics, base_failed, rule (number of the learned rule that rejects, or 0) and kept."""
    stats = written(statistics(docs).drop("text"), "statistics")
    rules = learn(stats, labels, **how)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.rejected_by())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def report(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    return judge(docs.select("doc_id", "text"), labels, **how).select("doc_id", *BASE, "base_failed", "kept", "rule")


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that are kept. Statistics are measured twice, to learn and to judge, so that no text is written between."""
    rules = learn(statistics(docs.select("doc_id", "text")), labels, **how)
    measured = statistics(whole(docs, F.col("doc_id"), F.col("text")))
    return again(measured.where(~base_failed() & (rules.rejected_by() == 0)), docs.columns)
