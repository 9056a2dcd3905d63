"""Jaccard join of documents by word n-grams: T-occurrence search with DivideSkip, exact for the threshold.

1. A document's set of shingles is a sorted array of 64-bit hashes. Equal sets are one class; its smallest doc_id stands for it.
2. Which classes can meet: similar sets of about one size differ in at most k shingles, so of more than k parts of the shingles
   (by hash) one is the same in both. Classes that share a part's content are chained, and the chains' components are the blocks
   within which links may exist. This step loses nothing and holds k + 1 rows a document.
3. In each block, inverted lists of shingles answer T-occurrence searches: the lists of a document are divided into the longest
   ones and the rest; the short ones are merged on a heap, what occurs in them often enough is looked up in the long ones by
   binary search, and documents that reach the needed overlap are its partners.

A block is searched only until its documents are connected: whoever is not yet in the block's largest group is searched, so no
link between groups is lost and copies are never paired with one another. A block of more than `block_rows` sets or `block_size`
shingles is cut into slices, some sets going to all of them, and each slice is searched by itself. What is then outside the block's
largest group is dealt anew, with a sample of that group, as long as that halves it. Whoever is still outside visits the slices
that hold a set with one of its parts, and only these: of two linked sets in different groups one at least is outside, and they share a
part, so this finds what is left. Slices lie on partitions of their own choosing, a block's one after another.

Defined results: text that is null or has no words has an empty set and no link, its component is itself; a text of fewer words
than n has its whole sequence as one shingle; repeated rows get a row each; rows with a null doc_id link like others, and a component_id
is null only if every row that is reached has a null one; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tesserae.llm.common import again, at_most, dealt, drop_table, id_key, join_hot, ready, small, text_of, tidied, whole, written
from tesserae.operators.components import connected_components

#: Set sizes are banded by this ratio; parts are counted for the largest set of a band.
BAND = 2.0
#: Parts for each one that similar sets may differ in.
SPREAD = 1.6
#: Made ids for null doc_ids lie above this, real ids below.
NO_ID = 1 << 61
#: Words whose hashes a worker keeps, at some 150 bytes each.
WORDS_KEPT = 100_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_words: dict[bytes, int] = {}


def _forget() -> None:
    _words.clear()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _B
    return (h ^ (h >> np.uint64(32))) * _C


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams, A-Z in lower case."""
    global _words
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    try:
        ids = [*map(_words.__getitem__, words)]
    except KeyError:
        if len(_words) > WORDS_KEPT:
            _words = {}
        for w in words:
            if w not in _words:
                _words[w] = xxhash.xxh64_intdigest(w)
        ids = [*map(_words.__getitem__, words)]
    h = np.array(ids, np.uint64)
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _A + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def needed(a, b, threshold: tuple[int, int]):
    """Least overlap of sets of a and b shingles that are similar: overlap / (a + b - overlap) >= threshold."""
    p, q = threshold
    return -(-p * (a + b) // (p + q))


def parts(s: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Signatures of which two similar sets have one in common.

    A band holds sizes from BAND ** b up; a set also takes part in the bands below where a similar smaller set may be. In a band,
    shingles are dealt to parts by hash. Similar sets x and y differ in at most |x| + |y| - 2 needed(x, y) parts, so among more parts
    than that of x one is the same in y. A set gives the largest of its parts only, just more than it may differ in: which ones follows
    from what they hold, so of two sets the one that stops earlier finds its common part given by the other too. A set with too
    few parts that hold anything gives all, empty ones too.
    """
    p, q = threshold
    enough = (q - p) * (len(s) + q * len(s) // p) // (p + q) + 1
    band_of = lambda size: int(math.log(max(1, size)) / math.log(BAND) + 1e-9)
    out = []
    for band in range(band_of(-(-p * len(s) // q)), band_of(len(s)) + 1):
        k = int(SPREAD * BAND ** (band + 1) * (1 + q / p) * (q - p) / (p + q)) + 2
        # the part of a shingle: the high bits of its mixed hash, over k
        part = (((_mix(s * _C + np.uint64(band)) >> np.uint64(33)) * np.uint64(k)) >> np.uint64(31)).astype(np.int64)
        sums = np.zeros(k, np.uint64)
        np.add.at(sums, part, _mix(s * _B + _A))
        load = np.bincount(part, minlength=k)
        signed = _mix((sums ^ (np.arange(k, dtype=np.uint64) * _A)) + _mix(np.full(1, band + 1, np.uint64)))
        full = np.flatnonzero(load)
        given = full[np.lexsort((signed[full], -load[full]))[:enough]] if len(full) >= enough else np.arange(k)
        out.append(signed[given].view(np.int64))
    return np.concatenate(out)


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


DOC, HEAD, TIE = 0, 1, 2
_SIGNED = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("e", pa.int64())])


def signatures(docs: DataFrame, n: int, threshold: tuple[int, int], held: int = 400_000) -> DataFrame:
    """Rows of three kinds. DOC: doc_id, hash of the text, set size, two hashes of the set, the first of which is the node that equal
    sets share. HEAD: part, node. TIE: two nodes with a common part.

    Of the nodes in a chunk (`held` parts) that have a part in common only the first goes on as HEAD, the next ones are tied to it, so
    a part that many share comes down to a row a chunk. Rows of a node stay together, which compresses them.
    """

    def chunk(docs_: list[tuple], nodes: list[int], sizes: list[int], own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        none = [None] * len(docs_)
        yield _rows(_SIGNED, [DOC] * len(docs_), *(zip(*docs_, strict=True) if docs_ else [none] * 5))
        if not nodes:
            return
        part, node = np.concatenate(own), np.repeat(np.array(nodes, np.int64), sizes)
        order = np.lexsort((node, part))
        again = np.append(False, part[order][1:] == part[order][:-1])
        ties = np.unique(np.stack([node[order][:-1][again[1:]], node[order][1:][again[1:]]]), axis=1)
        ties = ties[:, ties[0] != ties[1]]
        first = np.sort(order[~again])
        for at in range(0, len(first), 50_000):
            k = first[at : at + 50_000]
            empty = np.zeros(len(k), np.int64)
            yield _rows(_SIGNED, np.full(len(k), HEAD, np.int8), part[k], node[k], empty, empty, empty)
        empty = np.zeros(ties.shape[1], np.int64)
        yield _rows(_SIGNED, np.full(ties.shape[1], TIE, np.int8), ties[0], ties[1], empty, empty, empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_, nodes, sizes, own, size, known = [], [], [], [], 0, set()
        for given in batches:
            for doc_id, t, text in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), given.column(2), strict=True):
                s = shingles(text.as_py(), n)
                h = xxhash.xxh3_128_digest(s.tobytes())
                h0, h1 = int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)
                docs_.append((doc_id, t, len(s), h0, h1))
                if len(s) and h0 not in known:
                    known.add(h0)
                    p = parts(s, threshold)
                    nodes.append(h0)
                    sizes.append(len(p))
                    own.append(p)
                    size += len(p)
                if size > held:
                    yield from chunk(docs_, nodes, sizes, own)
                    docs_, nodes, sizes, own, size, known = [], [], [], [], 0, set()
        yield from chunk(docs_, nodes, sizes, own)

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("t"), text_of().cast("binary").alias("text")).mapInArrow(tidied(run, _forget), "kind byte, a long, b long, c long, d long, e long")


class Lists:
    """Inverted lists of a block's sets, sorted by the number of the set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")  # of equal shingles that of the lower set first
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        every = every[order]
        del order
        self.first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
        self.keys = every[self.first]
        self.last = np.append(self.first[1:], len(every))

    def search(self, s: np.ndarray, threshold: tuple[int, int]) -> list[int]:
        """Numbers of the sets similar to s: T-occurrence by DivideSkip."""
        if not len(s) or not len(self.keys):
            return []
        p, q = threshold
        low, high = -(-p * len(s) // q), q * len(s) // p  # sizes of similar sets
        t = int(needed(len(s), low, threshold))
        at = np.searchsorted(self.keys, s)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == s]
        if len(at) < t:
            return []
        lengths = self.last[at] - self.first[at]
        by = np.argsort(lengths, kind="stable")
        at, lengths = at[by], lengths[by]
        # the longest lists are set aside: more of them, the shorter they are together
        n_long = min(t - 1, int(t / (0.01 * math.log2(max(2, int(lengths[-1]))) + 1)))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        found = [self.owner[self.first[k] : self.last[k]] for k in long]
        enough, counts, seen, size = [], [], -1, 0
        for d in heapq.merge(*[self.owner[self.first[k] : self.last[k]].tolist() for k in short]):
            if d != seen:
                if size >= t - n_long:
                    enough.append(seen)
                    counts.append(size)
                seen, size = d, 0
            size += 1
        if size >= t - n_long and seen >= 0:
            enough.append(seen)
            counts.append(size)
        # look these up in the long lists while they can still reach their need
        d, times = np.array(enough, np.int32), np.array(counts, np.int64)
        fit = (self.sizes[d] >= low) & (self.sizes[d] <= high)
        d, times = d[fit], times[fit]
        need = needed(len(s), self.sizes[d], threshold)
        for i, k in enumerate(long):
            alive = times + (n_long - i) >= need
            if not alive.all():
                d, times, need = d[alive], times[alive], need[alive]
            if not len(d):
                break
            x = self.owner[self.first[k] : self.last[k]]
            j = np.searchsorted(x, d)
            j[j == len(x)] = 0
            times += x[j] == d
        return d[times >= need].tolist()


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))
        self.size = [1] * n

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            if self.size[x] < self.size[y]:
                x, y = y, x
            self.up[y] = x
            self.size[x] += self.size[y]


def connect(sets: list[np.ndarray], threshold: tuple[int, int], known: Union | None = None) -> Union:
    """Groups of sets connected by similarity.

    Who is outside the largest group is searched, until nobody there is left: a link between two groups is found from the one that
    isn't the largest.
    """
    groups = known or Union(len(sets))
    lists, todo = Lists(sets), set(range(len(sets)))
    top = max(todo, key=lambda x: groups.size[groups.root(x)], default=0)
    while True:
        outside = [x for x in sorted(todo) if groups.root(x) != groups.root(top)]
        if not outside:
            return groups
        for x in outside:
            if groups.root(x) == groups.root(top):
                continue
            todo.discard(x)
            for y in lists.search(sets[x], threshold):
                groups.join(x, y)
            if groups.size[groups.root(x)] > groups.size[groups.root(top)]:
                top = x


def visit(sets: list[np.ndarray], guests: list[int], threshold: tuple[int, int], known: Union) -> Union:
    """Groups of sets once each guest has been searched among those that aren't guests, or until all are one.

    A guest meets another one where that is at home, so lists of the hosts alone, of which there are fewer, lose no link.
    """
    away = set(guests)
    hosts = [i for i in range(len(sets)) if i not in away]
    lists, apart = Lists([sets[i] for i in hosts]), len({known.root(i) for i in range(len(sets))})
    for x in guests:
        if apart == 1:
            break
        for k in lists.search(sets[x], threshold):
            y = hosts[k]
            apart -= known.root(x) != known.root(y)
            known.join(x, y)
    return known


def _grouped(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list[int], list[int], list[bool], list[np.ndarray]]]:
    """Nodes, groups, guests and sets of the rows of a block and part; batches are sorted by these."""
    key, own = None, ([], [], [], [])
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(5)]
        for block, part, *row, text in zip(*cols, b.column(5), strict=True):
            if (block, part) != key:
                if key is not None:
                    yield own
                key, own = (block, part), ([], [], [], [])
            for column, x in zip(own, (*row, shingles(text.as_py(), n)), strict=True):
                column.append(x)
    if key is not None:
        yield own


def _connected(rows: DataFrame, n: int, threshold: tuple[int, int], partitions: int) -> DataFrame:
    """node, group of rows (block, part, node, group, text, and guest, if only guests are to be searched): connected within a block and
    part; nodes of one group start together."""
    schema = pa.schema([("node", pa.int64()), ("group", pa.int64())])
    visits = "guest" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, groups, guests, sets in _grouped(batches, n):
            known, first = Union(len(nodes)), {}
            for i, (node, group) in enumerate(zip(nodes, groups, strict=True)):
                for k in (node, group):
                    known.join(i, first.setdefault(k, i))
            if visits:
                known = visit(sets, [i for i, x in enumerate(guests) if x], threshold, known)
            else:
                known = connect(sets, threshold, known)
            least: dict[int, int] = {}
            for i, node in enumerate(nodes):
                r = known.root(i)
                least[r] = min(least.get(r, node), node)
            yield _rows(schema, nodes, [least[known.root(i)] for i in range(len(nodes))])

    at = F.pmod(F.xxhash64("block") + F.col("part"), F.lit(partitions)).cast("int")
    rows = rows.select("block", "part", "node", "group", F.col("guest") if visits else F.lit(False).alias("guest"), "text")
    return rows.repartitionById(partitions, at).sortWithinPartitions("block", "part").mapInArrow(tidied(run, _forget), "node long, group long")


def _part_rows(rows: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """block, part (slice), node, out, sig of rows (block, part, node, out, text): a row for each part of a set's shingles."""
    schema = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("node", pa.int64()), ("out", pa.bool_()), ("sig", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [parts(shingles(t.as_py(), n), threshold) for t in b.column(4)]
            again = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(again)) for k in range(4)), pa.array(np.concatenate(own) if own else [], pa.int64())], schema=schema)

    return rows.select("block", F.col("part").cast("long"), "node", "out", "text").mapInArrow(tidied(run, _forget), "block long, part long, node long, out boolean, sig long")


def link_components(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), **how) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs. threshold: a fraction; how: options of labelled_rows()."""
    return labelled_rows(docs, n, threshold, **how).select("doc_id", "n_shingles", "component_id")


def labelled_rows(docs: DataFrame, n: int, threshold: tuple[int, int], block_size: int = 500_000, block_rows: int = 1_024, pivots: int = 4) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, component_id and label of each row of docs: rows of one group have one label, null
    for an empty set. block_size, block_rows: shingles and sets of a slice."""
    signed = written(signatures(docs.select("doc_id", "text"), n, threshold), "signatures")
    sig = written(signed.where(F.col("kind") == DOC).select(F.col("a").alias("doc_id"), F.col("b").alias("t"), F.col("c").alias("n_shingles"), F.col("d").alias("h0"), F.col("e").alias("h1")), "sets")
    heads = signed.where(F.col("kind") == HEAD).select(F.col("a").alias("part"), F.col("b").alias("node"))
    before = F.lag("node").over(Window.partitionBy("part").orderBy("node"))
    across = heads.select(before.alias("a"), F.col("node").alias("b")).where("a <> b")
    blocks = written(connected_components(across.unionAll(signed.where(F.col("kind") == TIE).select("a", "b")).distinct(), "a", "b").withColumnRenamed("component", "block"), "blocks")
    drop_table(signed)

    # of equal sets one row's text goes into the block
    key = F.struct(id_key().alias("_id"), "t")
    first = sig.where("n_shingles > 0").groupBy("h0", "h1").agg(F.min(key).alias("k"), F.first("n_shingles").alias("size"))
    inside = written(first.select(F.col("k._id").alias("_id"), F.col("k.t").alias("t"), F.col("h0").alias("node"), "size").join(small(blocks), "node"), "inside")
    total = inside.agg(F.sum("size")).first()[0] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // 1_000_000))
    slices = inside.groupBy("block").agg(F.ceil(F.greatest(F.sum("size") / block_size, F.count("*") / block_rows)).cast("int").alias("slices")).where("slices > 1")
    many = written(slices, "many")
    part = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    placed = inside.join(small(many), "block", "left").withColumn("slices", F.coalesce("slices", F.lit(1))).withColumn("part", part)
    placed = written(placed.select("_id", "t", "node", "block", "slices", "part", F.col("node").alias("group")), "placed")
    texts = docs.select(id_key().alias("_id"), F.xxhash64(text_of()).alias("t"), text_of().cast("binary").alias("text"))
    repeated = sig.groupBy(id_key().alias("_id"), "t").agg(F.count("*").alias("n")).where("n > 1")
    once = at_most(repeated, 0)

    def with_text(rows: DataFrame) -> DataFrame:
        out = texts.join(small(rows), ["_id", "t"])
        return out if once else out.dropDuplicates(["_id", "t", "block", "part"])

    rows = placed.drop("slices")
    sliced = not at_most(many, 0)
    if sliced:
        # some of a block's sets go to all of its slices and tie these together
        rank = F.row_number().over(Window.partitionBy("block").orderBy("node"))
        spread = placed.where("slices > 1").withColumn("_k", rank).where(F.col("_k") <= pivots)
        extra = spread.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).where("_part <> part")
        rows = rows.unionByName(extra.select("_id", "t", "node", "block", F.col("_part").alias("part"), "group"))
    found = written(_connected(with_text(rows), n, threshold, partitions), "connected")
    if sliced:
        search = lambda rows: written(_connected(with_text(rows), n, threshold, partitions), "connected")
        found = _joined_slices(found, placed, search, lambda rows: _part_rows(with_text(rows), n, threshold), block_rows)
    label = found.groupBy("node").agg(F.min("group").alias("label"))
    return _labelled(sig, label)


def _merged(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """found (node, group), groups that pairs (node, group: some node's number) tie made one."""
    ties = pairs.join(dealt(found.select("node", F.col("group").alias("g"))), "node").select("g", "group").distinct()
    tied = connected_components(ties, "g", "group").select(F.col("node").alias("group"), F.col("component").alias("_g"))
    return written(join_hot(found, tied, ["group"], salt_by=["node"]).select("node", F.coalesce("_g", "group").alias("group")), "tied")


def _joined_slices(found: DataFrame, placed: DataFrame, search, part_rows, block_rows: int) -> DataFrame:
    """Groups of blocks in several slices, which were searched one by one: nodes in more than one slice tie some; then see the module."""
    tied = connected_components(found, "node", "group").select("node", F.col("component").alias("_g"))
    found = written(found.join(dealt(tied), "node", "left").select("node", F.coalesce("_g", "group").alias("group")).distinct(), "tied")
    slices = placed.where("slices > 1").drop("group")
    before = None
    while True:
        at = written(slices.join(dealt(found), "node"), "sliced")
        sizes = at.groupBy("block", "group").agg(F.count("*").alias("n"))
        tops = sizes.groupBy("block").agg(F.max_by("group", F.struct("n", "group")).alias("top"), F.max("n").alias("n_top"), (F.sum("n") - F.max("n")).alias("n_out")).where("n_out > 0")
        tops = written(tops, "tops")
        left = tops.agg(F.sum("n_out")).first()[0] or 0
        if not left:
            return found
        named = join_hot(at, tops, ["block"], "inner", salt_by=["node"]).withColumn("out", F.col("group") != F.col("top"))
        if left <= 4 * block_rows or before is not None and 2 * left > before:
            break
        # dealt anew, as many of the largest group beside them: half a slice of each
        before = left
        draw = F.xxhash64("node", F.lit(left))
        units = F.ceil(2 * F.col("n_out") / block_rows)
        some = named.where(F.col("out") | (draw.cast("double") / 2.0**64 + 0.5 <= F.col("n_out") / F.col("n_top")))
        found = _merged(found, search(some.withColumn("part", F.pmod(F.xxhash64(draw), units)).select("_id", "t", "node", "block", "part", "group")))
    sigs = written(part_rows(named.select("_id", "t", "block", "part", "node", "out")), "parts")
    # the slices that hold a part, one row a part; then those that hold any of a set's parts
    mates = sigs.groupBy("block", "sig").agg(F.collect_set("part").alias("to"))
    mates = mates.join(small(sigs.where("out").select("block", "sig").distinct()), ["block", "sig"], "left_semi")
    near = join_hot(sigs.where("out").drop("out"), written(mates, "mates"), ["block", "sig"], "inner", salt_by=["node"])
    others = near.groupBy("block", "node", "part").agg(F.array_distinct(F.flatten(F.collect_set("to"))).alias("to"))
    visits = written(others.select("block", "node", F.explode(F.filter("to", lambda x: x != F.col("part"))).alias("to")), "visits")
    # a slice that many visit is there once for each chunk of them
    hosts = visits.groupBy("block", "to").agg(F.ceil(F.count("*") / (4 * block_rows)).cast("int").alias("chunks"))
    hosts = written(hosts.withColumnRenamed("to", "part"), "hosts")
    unit = lambda part, chunk: F.col(part).cast("long") * (1 << 20) + chunk
    home = join_hot(at, hosts, ["block", "part"], "inner", salt_by=["node"]).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    home = home.select("_id", "t", "node", "block", unit("part", F.col("_k")).alias("part"), "group", F.lit(False).alias("guest"))
    away = join_hot(visits.withColumnRenamed("to", "part"), hosts, ["block", "part"], "inner", salt_by=["node"])
    away = away.select("block", "node", unit("part", F.pmod(F.xxhash64("node"), F.col("chunks"))).alias("part"))
    guests = away.join(dealt(at.select("_id", "t", "node", "group")), "node").select("_id", "t", "node", "block", "part", "group", F.lit(True).alias("guest"))
    return _merged(found, search(home.unionByName(guests)))


def _labelled(sig: DataFrame, label: DataFrame) -> DataFrame:
    """The smallest doc_id of each row's group, and the group's label; a set outside all blocks is a group of its own."""
    classes = sig.where("n_shingles > 0").groupBy("h0", "h1").agg(F.min("doc_id").alias("m")).withColumnRenamed("h0", "node")
    grouped = written(classes.join(dealt(label), "node", "left").select("node", "h1", "m", F.coalesce("label", "node").alias("label")), "labelled")
    least = grouped.groupBy("label").agg(F.min("m").alias("component_id"))
    named = grouped.join(dealt(least), "label").select(F.col("node").alias("h0"), "h1", "component_id", "label")
    out = join_hot(sig, named, ["h0", "h1"], salt_by=["doc_id", "t"])
    full = F.col("n_shingles") > 0
    return out.select("doc_id", "t", "n_shingles", F.when(full, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(full, F.col("label")).alias("label"))


def deduplicate(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), **how) -> DataFrame:
    """docs with one row of each group of linked documents, that of the smallest doc_id (of its texts that with the least hash); texts
    without words all stay.

    A null doc_id counts as a large one made from the text. Repeated rows come down to one; different texts with one doc_id are told apart.
    """
    made = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.xxhash64(text_of()).bitwiseAND(F.lit(NO_ID - 1)))
    keyed = whole(docs, made.alias("_id"), F.xxhash64(text_of()).alias("_t"))
    linked = written(labelled_rows(docs.select(made.alias("doc_id"), "text"), n, threshold, **how), "linked").where("n_shingles > 0")
    first = linked.where("doc_id = component_id")
    several = written(first.groupBy("label").agg(F.count("*").alias("_n"), F.min("t").alias("_least")).where("_n > 1").select("label", "_least"), "several")
    gone = linked.where("doc_id <> component_id")
    repeated = join_hot(first, several, ["label"], "inner", salt_by=["t"])
    gone = gone.select("doc_id", "t").unionAll(repeated.where("t <> _least").select("doc_id", "t"))
    gone = gone.distinct().select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
    kept = keyed.join(small(gone), ["_id", "_t"], "left_anti")
    twice = written(repeated.where("t = _least").groupBy("doc_id", "t").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")), "repeated")
    if not at_most(twice, 0):
        many = kept.join(small(twice), ["_id", "_t"], "left_semi")
        kept = kept.join(small(twice), ["_id", "_t"], "left_anti").unionByName(many.dropDuplicates(["_id", "_t"]))
    return again(kept, docs.columns)
