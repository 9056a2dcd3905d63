"""Packing token sequences by bin completion, a branch-and-bound over fillings.

Pieces of equal length are the same to a packer, so the whole problem is a histogram of at most `capacity` lengths, whatever the
number of documents. pack_histogram() solves it on the driver: the largest length left is completed by undominated fillings, enumerated
without a limit, the fullest first; a branch is cut when its waste or a lower bound leaves no better total; the best-fit solution is the first
incumbent. The search ends at the lower bound, or after `steps` of it; both numbers are in the result. Its answer, patterns with
counts, is dealt to the pieces by their rank among those of their length; ranks are made of salted row numbers, as many salts as a length
needs, since one length may hold a third of all pieces.

Defined results: a null text is empty and yields one piece, the closing id; repeated rows are packed each; an empty table yields
no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tesserae.llm.common import at_most, ready, text_of, tidied, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
END = struct.pack("<I", 0)
#: Units whose ids a worker keeps during a task, at some 150 bytes each. Frequent ones are soon known again: 45 MB of text took as long
#: with 450,000.
WORDS_KEPT = 100_000
#: Fixed value: what the tokenizer cuts lower-case Latin-1 text into.
UNIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\t-\\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
#: Words, marks, digits, white space and letters on which a tokenizer shows whether ids may be kept by word.
PROBE = "The  quick brown-fox's Straße, don't 12.5% Émile\n\nnaïve (x2)\tK. ½ É. it's; ab.cd  END "


class Tokens:
    """Ids of texts by a public tokenizer file, as little-endian bytes: what encode(text, add_special_tokens=False) gives.

    A tokenizer that puts letters in lower case, cuts texts into UNITs and encodes each by itself has the ids of units kept; a unit
    goes straight to its model. Whether a file is of this kind is tried on PROBE. If not, it gets each text whole, as do texts with
    letters beyond Latin-1, whose rules are its own, and texts that hold a special token's string. With `plain` such strings are ordinary
    text, else the special token, as the library has it.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = [t.content.lower() for t in added if not plain]
        # the characters that all of them begin with and that have no case: a text without these is quickly done with
        self.sign = os.path.commonprefix([re.match(r"[^\w]*", x)[0] for x in self.specials])
        self.by_word = True
        self.model = self.tokenizer.model
        # the model sees bytes as characters: printable Latin-1 ones as themselves, the others from U+0100 on
        other = [x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x)]
        self.as_seen = {x: 256 + k for k, x in enumerate(other)}
        self.ids: dict[str, bytes] = {}
        try:
            self.by_word = self(PROBE) == self._whole(PROBE)
        except Exception:  # a model without this kind of words
            self.by_word = False

    def _whole(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def _learn(self, units: list[str]) -> None:
        if len(self.ids) > WORDS_KEPT:
            self.ids = {}
        ids, tokenize = self.ids, self.model.tokenize
        for u in set(units).difference(ids):
            found = [t.id for t in tokenize(u if u.isascii() and u.isprintable() else u.encode().decode("latin-1").translate(self.as_seen))]
            ids[u] = struct.pack(f"<{len(found)}I", *found)

    def __call__(self, text: str) -> bytes:
        if not self.by_word or self.specials and self.sign in text and any(x in text.lower() for x in self.specials):
            return self._whole(text)
        try:
            text.encode("latin-1")
        except UnicodeError:
            return self._whole(text)
        units = UNIT.findall(text.lower())
        try:
            return b"".join(map(self.ids.__getitem__, units))
        except KeyError:
            self._learn(units)
            return b"".join(map(self.ids.__getitem__, units))


_LOADED: dict[str, Tokens] = {}


def _forget() -> None:
    for tokens in _LOADED.values():
        tokens.ids = {}


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """PIECES of docs (and `ids`, little-endian, if asked for): each document's ids and a closing 0, cut where longer than capacity."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = _LOADED.get(tokenizer) or _LOADED.setdefault(tokenizer, Tokens(tokenizer))
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens(text.as_py()) + END
                for k, at in enumerate(range(0, len(ids), capacity * 4)):
                    part = ids[at : at + capacity * 4]
                    for col, x in zip(cols, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(tidied(pieces, _forget), PIECES + ", ids binary" * with_ids)


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's items can be parted into groups that each fit in an item of a (a, b: descending)."""
    rooms = list(a)

    def place(i: int) -> bool:
        if i == len(b):
            return True
        for k in range(len(rooms)):
            if rooms[k] >= b[i]:
                rooms[k] -= b[i]
                if place(i + 1):
                    return True
                rooms[k] += b[i]
        return False

    return place(0)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The least number of bins by Martello and Toth's L2: for each k, items over capacity - k share a bin with none of k or more, the
    other large items leave their rooms to those from k to half a bin."""
    n = np.zeros(capacity + 2, np.int64)
    for x, m in counts.items():
        n[x] = m
    items, tokens = np.cumsum(n), np.cumsum(n * np.arange(capacity + 2))
    k = np.arange(0, capacity // 2 + 1)
    alone = items[-1] - items[capacity - k]
    large, in_large = items[capacity - k] - items[capacity // 2], tokens[capacity - k] - tokens[capacity // 2]
    small = tokens[capacity // 2] - tokens[np.maximum(k - 1, 0)]
    return int((alone + large + np.maximum(0, -((large * capacity - in_large - small) // capacity))).max())


def _order(filling: tuple[int, ...]) -> tuple:
    return -sum(filling), [-x for x in filling]


class Work:
    """Steps of search that may still be made."""

    def __init__(self, steps: int):
        self.left = steps


def completions(room: int, left: dict[int, int], least: int = 0, work: Work | None = None) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of room from what is left, all of them while there is work left, the fullest first, down to a sum of `least`.

    Of fillings of one sum those of larger items come first, so what dominates a filling comes before it. Sums that no choice of
    lengths can give are left out, which keeps the search for a sum from running into dead ends.
    """
    fits = sorted((x for x, n in left.items() if x <= room and n > 0), reverse=True)
    whole = (1 << (room + 1)) - 1
    sums = 1  # bit s: lengths, used without limit, can add up to s
    for x in reversed(fits):
        step = x
        while step <= room and sums != whole:
            sums |= sums << step & whole
            step *= 2
    total = sum(x * min(left[x], room // x) for x in fits)
    work = work or Work(1 << 62)

    def adding(t: int, k: int) -> Iterator[tuple[int, ...]]:
        if not t:
            yield ()
            return
        for i in range(bisect_left(fits, -t, lo=k, key=neg), len(fits)):
            x = fits[i]
            work.left -= 1
            if work.left < 0:
                return
            for m in range(min(left[x], t // x), 0, -1):
                if sums >> (t - m * x) & 1:
                    for rest in adding(t - m * x, i + 1):
                        yield (x,) * m + rest

    found: list[tuple[int, ...]] = []
    for t in range(min(room, total), max(least, 0) - 1, -1):
        if sums >> t & 1:
            for f in adding(t, 0):
                work.left -= len(found)
                if len(f) > 8 or not any(len(g) <= 8 and _dominates(g, f) for g in found):
                    found.append(f)
                    yield f
                    if t == room and len(f) <= 1:  # dominates all others
                        return


def pack_histogram(counts: dict[int, int], capacity: int, steps: int = 2_000_000) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, descending) and how often each is used; the fewest bins that are found within `steps` of search.

    What each branch leaves is packed by best fit too, and the best of these solutions is the incumbent. Ends early at lower_bound(), which proves the answer, or when every branch was cut or tried, which does too. A branch takes one filling
    of the largest item so many times, most often first; what follows it takes only later fillings of that item, so no solution
    comes twice. A branch is cut if its waste, or the lower bound of what it leaves, allows no better total.
    """
    left = {x: n for x, n in counts.items() if n}
    if not left:
        return []
    bound = lower_bound(left, capacity)
    best = _best_fit(left, capacity)
    fewest = sum(t for _, t in best)
    work = Work(steps)
    path: list[tuple[tuple[int, ...], int]] = []
    tokens, bins = sum(x * n for x, n in left.items()), 0

    def take(pattern: tuple[int, ...], times: int) -> None:
        for x, n in Counter(pattern).items():
            left[x] = left.get(x, 0) - n * times
            if not left[x]:
                del left[x]

    def branches(top: int, later: tuple[int, ...] | None) -> Iterator[tuple[tuple[int, ...], tuple[int, ...], int]]:
        others = left | {top: left[top] - 1}
        slack = (fewest - 1 - bins) * capacity - tokens
        for f in completions(capacity - top, others, capacity - top - slack, work):
            if later is None or _order(f) > _order(later):
                pattern = tuple(sorted((top, *f), reverse=True))
                for times in range(min(left[x] // n for x, n in Counter(pattern).items()), 0, -1):
                    yield f, pattern, times

    stack = [branches(max(left), None)]
    while stack and fewest > bound and work.left > 0:
        branch = next(stack[-1], None)
        if branch is None:
            stack.pop()
            if path:
                pattern, times = path.pop()
                take(pattern, -times)
                tokens += sum(pattern) * times
                bins -= times
            continue
        work.left -= 10 + 2 * len(left)
        f, pattern, times = branch
        take(pattern, times)
        path.append((pattern, times))
        tokens -= sum(pattern) * times
        bins += times
        able = bins + -(-tokens // capacity) < fewest and bins + lower_bound(left, capacity) < fewest
        if able:
            rest = _best_fit(left, capacity)
            work.left -= len(rest) * len(left) // 2
            if bins + sum(t for _, t in rest) < fewest:
                best, fewest = path + rest, bins + sum(t for _, t in rest)
        top = pattern[0]
        stack.append(branches(max(left), f if left.get(top) else None) if left and able else iter(()))
    return best


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The first incumbent: the largest item left, then again and again the largest that fits, as often as that can be had."""
    left, out = dict(counts), []
    while left:
        lengths, pattern, room = sorted(left), [], capacity
        for x in reversed(lengths):
            n = min(left[x], room // x)
            pattern += [x] * n
            room -= n * x
            if room < lengths[0]:
                break
        uses = Counter(pattern)
        times = min(left[x] // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((tuple(pattern), times))
    return out


def place(pieces: DataFrame, capacity: int = 2048, steps: int = 2_000_000, run: int = 1_000) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset, n_sequences (how many there are) and least_sequences (the lower
    bound). pieces is read three times: pass a written table. A length of many pieces is numbered in parts of `run` pieces or so."""
    spark = pieces.sparkSession
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    many = F.create_map(*[F.lit(v) for x, n in hist.items() if n > run for v in (x, -(-n // run))]) if any(n > run for n in hist.values()) else None
    salts = F.lit(1) if many is None else F.coalesce(F.element_at(many, F.col("length")), F.lit(1))
    tagged = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts).cast("int"))
    # a row for each length and `run` pieces
    sizes = written(tagged.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "lengths")
    before = sizes.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    patterns = pack_histogram(hist, capacity, steps)
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
    given: Counter = Counter()
    first = 0
    for pattern, times in patterns:
        at = 0
        for x, n in sorted(Counter(pattern).items(), reverse=True):
            runs.setdefault(x, []).append((given[x], given[x] + n * times, first, n, at))
            given[x] += n * times
            at += x * n
        first += times
    plan = spark.createDataFrame([(x, r) for x, r in runs.items()], "length long, _runs array<struct<lo:long,hi:long,seq:long,n:long,at:long>>")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1 + F.col("_before")
    ranked = tagged.join(F.broadcast(before) if at_most(before) else before, ["length", "_salt"]).withColumn("_rank", rank.cast("long"))
    run = F.get(F.filter("_runs", lambda r: (r["lo"] <= F.col("_rank")) & (F.col("_rank") < r["hi"])), F.lit(0))
    placed = ranked.join(F.broadcast(plan), "length").withColumn("_run", run).withColumn("_k", F.col("_rank") - F.col("_run.lo"))
    return placed.select(
        *pieces.columns,
        (F.col("_run.seq") + F.floor(F.col("_k") / F.col("_run.n"))).cast("long").alias("sequence_id"),
        (F.col("_run.at") + F.col("_k") % F.col("_run.n") * F.col("length")).cast("long").alias("offset"),
        F.lit(first).cast("long").alias("n_sequences"),
        F.lit(lower_bound(hist, capacity)).cast("long").alias("least_sequences"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = False, **how) -> DataFrame:
    return place(written(cut(docs, tokenizer, capacity, with_ids), "pieces"), capacity, **how)
