r"""Benchmark decontamination by a distributed positional inverted index.

build_index() cuts the documents into segments of `segment_bytes` of text; each segment stores, as rows of one table, its
documents (number of words, first position) and its terms with their sorted positions. search() takes the benchmark's windows of
`width` words to every segment: the positions of a window's rarest term there are the candidates; the lists of the next rarest
terms, adjusted by their offsets, are intersected with these. What has each term in its place is an exact match; a proximity match has all
of a window's terms, in any order, within `reach` successive words of one document, however documents were cut into segments.

The benchmark travels to the segments in blocks of `block_windows` windows, so neither it nor the index needs to fit anywhere; long items
are cut into pieces that overlap by a window but for a word.

Defined results: null texts have no words and no hits; an item without words has no window; repeated items count once by item_id, a
null item_id is the empty string; repeated documents get a row each; empty tables give empty tables or no hits; other columns are
ignored. Positions are words, counted from 0 in each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tesserae.llm.common import BROADCAST_ROWS, again, at_most, id_key, ready, text_of, tidied, whole, written

#: Bytes of words as they are, A-Z in lower case, the rest as spaces. Bytes from 0x80 belong to letters beyond ASCII.
_WORD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Fixed value: a word of the contract.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INDEX = "segment long, term binary, doc_id long, h long, at int, n int, positions binary"


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def build_index(docs: DataFrame, vocabulary: Broadcast | None = None, segment_bytes: int = 8 << 20) -> DataFrame:
    """Rows of terms (term, n, positions) and of documents (doc_id, h: hash of the text, at: first position, n: words) by segment.

    With a vocabulary (a broadcast set of words) only its terms are stored, and only benchmarks of these words can be searched. Documents are one position apart, so that no phrase runs over a document's end.
    """
    schema = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("doc_id", pa.int64()), ("h", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("positions", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32

        def stored(held: list[tuple]) -> pa.RecordBatch:
            number = {w: i for i, w in enumerate(vocabulary.value)} if vocabulary is not None else {}
            at, starts, sizes, codes_, places_ = 0, [], [], [], []
            for _, _, text in held:
                own = words(text)
                if vocabulary is None:
                    codes = np.array([number.setdefault(w, len(number)) for w in own], np.int32)
                else:
                    codes = np.array([number.get(w, -1) for w in own], np.int32)
                known = np.flatnonzero(codes >= 0)
                codes_.append(codes[known])
                places_.append((known + at).astype(np.int32))
                starts.append(at)
                sizes.append(len(own))
                at += len(own) + 1
            terms, codes, places = [*number], np.concatenate(codes_), np.concatenate(places_)
            order = np.argsort(codes, kind="stable")
            codes, places = codes[order], places[order].astype("<i4")
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            last = np.append(first[1:], len(codes))[: len(first)]
            n_t, n_d = len(first), len(held)
            raw = places.tobytes()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n_t + n_d, segment)),
                    pa.array([terms[c] for c in codes[first]] + [None] * n_d, pa.binary()),
                    pa.array([None] * n_t + [x[0] for x in held], pa.int64()),
                    pa.array([None] * n_t + [x[1] for x in held], pa.int64()),
                    pa.array([None] * n_t + starts, pa.int32()),
                    pa.array([*(last - first).tolist(), *sizes], pa.int32()),
                    pa.array([raw[4 * a : 4 * b] for a, b in zip(first.tolist(), last.tolist(), strict=True)] + [None] * n_d, pa.binary()),
                ],
                schema=schema,
            )

        held, size = [], 0
        for b in batches:
            for doc_id, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py()
                if held and size + len(text) > segment_bytes:
                    yield stored(held)
                    segment, held, size = segment + 1, [], 0
                held.append((doc_id, h, text))
                size += len(text)
        if held:
            yield stored(held)

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("h"), text_of().cast("binary").alias("text")).mapInArrow(tidied(run), INDEX)


class Windows:
    """The windows of benchmark items: distinct ones by length, as numbers of terms, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.number: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        of_item = {i: k for k, i in enumerate(self.items)}
        found: dict[tuple[int, ...], set[int]] = {}
        for i, text in items:
            own = [self.number.setdefault(w, len(self.number)) for w in words(text)]
            for k in range(max(1, len(own) - width + 1) if own else 0):
                found.setdefault(tuple(own[k : k + width]), set()).add(of_item[i])
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n in {len(w) for w in found}:
            own = [w for w in found if len(w) == n]
            self.by_length[n] = np.array(own, np.int32), [sorted(found[w]) for w in own]


_SPACE = np.int64(1) << 32


def _expand(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _within(lists: np.ndarray, terms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether each of terms has a posting from lo to hi (one of each a row)."""
    at = np.searchsorted(lists, terms * _SPACE + lo)
    at[at == len(lists)] = 0
    return (lists[at] >= terms * _SPACE + lo) & (lists[at] <= terms * _SPACE + hi)


def match(windows: np.ndarray, lists: np.ndarray, first: np.ndarray, length: np.ndarray, starts: np.ndarray, sizes: np.ndarray, reach: int, most: int = 500_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Matches of windows (terms' numbers, one row each) in a segment: exact (window, start) and proximity (window, place).

    lists: all postings as term * 2**32 + position, ascending; first, length: each term's place there; starts, sizes: the documents'. In
    chunks of candidates.
    """
    alive = np.flatnonzero((length[windows] > 0).all(axis=1))
    if not len(alive):
        return
    order = np.argsort(length[windows[alive]], axis=1, kind="stable")  # rarest first
    rarest = np.take_along_axis(windows[alive], order[:, :1], 1)[:, 0]
    load = np.cumsum(length[rarest])
    cuts = np.searchsorted(load, np.arange(0, load[-1], most)).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(alive)], strict=True):
        if lo == hi:
            continue
        counts = length[rarest[lo:hi]]
        which = np.repeat(np.arange(lo, hi), counts)
        place = lists[np.repeat(first[rarest[lo:hi]], counts) + _expand(counts)] & (_SPACE - 1)
        exact, places = which, place
        doc = np.searchsorted(starts, place, "right") - 1
        begin, end = starts[doc], starts[doc] + sizes[doc] - 1
        for k in range(1, windows.shape[1]):  # proximity: a posting of the k-th rarest term near enough to the rarest
            term = windows[alive[which], order[which, k]]
            near = _within(lists, term, np.maximum(place - reach + 1, begin), np.minimum(place + reach - 1, end))
            which, place, begin, end = which[near], place[near], begin[near], end[near]
            if not len(which):
                break
        near_w, near_p = [], []
        for back in range(reach if len(which) else 0):  # and all of them in one stretch, which starts so far before it
            lo, hi = np.maximum(place - back, begin), np.minimum(place - back + reach - 1, end)
            ok = np.ones(len(which), bool)
            for k in range(1, windows.shape[1]):
                left = np.flatnonzero(ok)
                ok[left] = _within(lists, windows[alive[which[left]], order[which[left], k]], lo[left], hi[left])
            near_w.append(alive[which[ok]])
            near_p.append(place[ok])
            which, place, begin, end = which[~ok], place[~ok], begin[~ok], end[~ok]
        near_w, near_p = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (near_w, near_p))
        which, place = exact, places
        start = place - order[which, 0]
        ok = start >= 0
        which, start = which[ok], start[ok]
        for k in range(1, windows.shape[1]):  # exact: the offset-adjusted lists
            key = windows[alive[which], order[which, k]] * _SPACE + start + order[which, k]
            at = np.searchsorted(lists, key)
            at[at == len(lists)] = 0
            here = lists[at] == key
            which, start = which[here], start[here]
            if not len(which):
                break
        yield alive[which], start, near_w, near_p


def _segment(rows: list[tuple], windows: Windows, reach: int) -> tuple[list, ...]:
    """doc_id, h, n_words, spans, items and near items of a segment's documents."""
    docs = sorted((r for r in rows if r[0] is None), key=lambda r: r[3])
    held = sorted((windows.number[r[0]], r) for r in rows if r[0] is not None and r[0] in windows.number)
    starts, sizes = np.array([r[3] for r in docs], np.int64), np.array([r[4] for r in docs], np.int64)
    first, length = np.zeros(len(windows.number), np.int64), np.zeros(len(windows.number), np.int64)
    parts, at = [], 0
    for k, r in held:
        first[k], length[k] = at, r[4]
        parts.append(np.frombuffer(r[5], "<i4").astype(np.int64) + k * _SPACE)
        at += r[4]
    lists = np.concatenate(parts) if parts else np.empty(0, np.int64)
    end = int(starts[-1] + sizes[-1]) if len(docs) else 0
    cover = np.zeros(end + 2, np.int64)
    items: list[set[int]] = [set() for _ in docs]
    near: list[set[int]] = [set() for _ in docs]
    for n, (table, of) in windows.by_length.items():
        for w, start, near_w, near_p in match(table, lists, first, length, starts, sizes, reach):
            np.add.at(cover, start, 1)
            np.add.at(cover, start + n, -1)
            for ids, places, into in ((w, start, items), (near_w, near_p, near)):
                if len(ids):
                    d = np.searchsorted(starts, places, "right") - 1
                    for k in np.unique(d * (len(of) + 1) + ids).tolist():
                        into[k // (len(of) + 1)].update(of[k % (len(of) + 1)])
    hit = np.cumsum(cover)[: end + 1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    spans: list[list[dict]] = [[] for _ in docs]
    for k, a, b in zip((np.searchsorted(starts, lo, "right") - 1).tolist(), lo.tolist(), hi.tolist(), strict=True):
        spans[k].append({"s": a - int(starts[k]), "e": b - int(starts[k])})
    name = windows.items
    return [r[1] for r in docs], [r[2] for r in docs], sizes.tolist(), spans, [sorted(name[i] for i in x) for x in items], [sorted(name[i] for i in x) for x in near]


FOUND = "doc_id long, h long, n_words long, spans array<struct<s:long,e:long>>, items array<string>, near array<string>"


def search(index: DataFrame, windows: Broadcast, reach: int) -> DataFrame:
    """FOUND for every document of the index: spans of words that an exact match covers, items with exact and proximity matches."""
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.list_(pa.string()), pa.list_(pa.string())]
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_segment(rows, windows.value, reach), kinds, strict=True)], names)

        for b in batches:
            segments = b.column(0).to_pylist()
            for segment, *row in zip(segments, *(b.column(k).to_pylist() for k in range(1, 7)), strict=True):
                if segment != now and rows:
                    yield done()
                    rows = []
                now = segment
                rows.append(tuple(row))
        if rows:
            yield done()

    ready(index.sparkSession)
    return index.repartition("segment").sortWithinPartitions("segment").mapInArrow(tidied(run), FOUND)


def _pieces(benchmark: DataFrame, width: int, most: int = 10_000) -> DataFrame:
    """id, text and windows (how many) of the items' pieces of `most` windows at most, their words in lower case between spaces."""
    low = F.translate(text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.regexp_extract_all(low, F.lit(ITEM_WORD), F.lit(0)).alias("w"))
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size("w") - width, F.lit(0)) / most).cast("int"))
    parts = items.where(F.size("w") > 0).select("id", F.explode(F.transform(starts, lambda k: F.slice("w", k * most + 1, F.lit(most + width - 1)))).alias("w"))
    return parts.select("id", F.array_join("w", " ").cast("binary").alias("text"), F.greatest(F.lit(1), F.size("w") - width + 1).alias("windows")).distinct()


def find(docs: DataFrame, benchmark: DataFrame, width: int = 13, reach: int = 24, block_windows: int = 200_000) -> DataFrame:
    """FOUND for every row of docs."""
    items = written(_pieces(benchmark, width), "items")
    sc = docs.sparkSession.sparkContext
    total = items.agg(F.sum("windows")).first()[0] or 0
    blocks = max(1, -(-total // block_windows))

    def block(k: int) -> Windows:  # some block_windows windows, one item's piece more or less
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        return Windows([(r["id"], bytes(r["text"])) for r in rows.collect()], width)

    if blocks == 1:
        windows = block(0)
        vocabulary = sc.broadcast(frozenset(windows.number)) if len(windows.number) <= BROADCAST_ROWS else None
        return search(written(build_index(docs, vocabulary), "index"), sc.broadcast(windows), reach)
    index = written(build_index(docs), "index")
    out = None
    for k in range(blocks):
        shared = sc.broadcast(block(k))
        found = written(search(index, shared, reach), "found")
        shared.unpersist()
        out = found if out is None else out.unionAll(found)
    copies = out.groupBy("doc_id", "h", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"), (F.count("*") / blocks).cast("int").alias("_n"))
    return copies.select(*[x.split()[0] for x in FOUND.split(", ")], F.explode(F.sequence(F.lit(1), "_n")).alias("_k")).drop("_k").mapInArrow(_merge_spans, FOUND)


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FOUND, spans that overlap or touch joined."""
    for b in batches:
        merged = []
        for spans in b.column(3).to_pylist():
            own: list[dict] = []
            for x in sorted(spans, key=lambda x: (x["s"], x["e"])):
                if own and x["s"] <= own[-1]["e"]:
                    own[-1]["e"] = max(own[-1]["e"], x["e"])
                else:
                    own.append(x)
            merged.append(own)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(merged, b.column(3).type), *b.columns[4:]], b.schema.names)


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """n_hit and contaminated: hit words are at least one in `share`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    out = judged(find(docs, benchmark, **how))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without its contaminated rows."""
    bad = judged(find(docs, benchmark, **how)).where("contaminated").select(id_key().alias("_id"), F.col("h").alias("_h")).distinct()
    kept = whole(docs, id_key().alias("_id"), F.xxhash64(text_of()).alias("_h")).join(F.broadcast(bad) if at_most(bad) else bad, ["_id", "_h"], "left_anti")
    return again(kept, docs.columns)
