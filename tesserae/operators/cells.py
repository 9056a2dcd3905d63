"""Boxes by grid cells: kernels over all pairs of a cell as matrices, for links, for what links tie together, and for suppression.

A box goes to every cell that it covers; a cell's rows, in order, stream through one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesserae.session import ready

BOX = ("x0", "y0", "x1", "y1")
#: Boxes that meet all others of a cell at a time, and rows of a batch of results.
BLOCK, OUT_ROWS = 64, 50_000
#: Lists of a mask's runs; entries of a matrix of all masks of a cell at most, and rows of a band where they are more.
RUN, DENSE, BAND = ("mask_y", "mask_x0", "mask_x1"), 1 << 22, 128


def by_cells(boxes: DataFrame, side: float, same: tuple[str, ...], kernel: Callable[[tuple, pa.Table], Iterator[pa.Table]], schema: str, shift: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """kernel((_gx, _gy, *same), rows) of every cell of a grid moved by `shift`. rows have the columns of boxes, and _cells: of how many
    cells a box is."""
    span = lambda lo, hi, by: F.sequence(F.floor((F.col(lo) - by) / side), F.floor((F.col(hi) - by) / side))
    spread = boxes.withColumn("_xs", span("x0", "x1", shift[0])).withColumn("_ys", span("y0", "y1", shift[1])).withColumn("_cells", (F.size("_xs") * F.size("_ys")).cast("long"))
    held = spread.withColumn("_gx", F.explode("_xs")).withColumn("_gy", F.explode("_ys")).drop("_xs", "_ys")
    keys = ["_gx", "_gy", *same]
    parts = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an exchange of a given number of parts: a cell's rows are few for the work that they are
    dealt = held.repartition(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in in_turn(batches, keys):
            for out in kernel(key, rows):
                yield from out.to_batches(max_chunksize=OUT_ROWS)

    ready(boxes.sparkSession)
    return dealt.mapInArrow(run, schema)


def in_turn(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of equal keys, which follow one another."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in keys]
        edge = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            edge |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def _numbers(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy().astype(np.float64) for c in names]


def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x / y, 0 where that isn't known."""
    with np.errstate(all="ignore"):
        return np.where((y == 0) | np.isnan(y) | np.isnan(x), 0.0, x / np.where(y == 0, 1.0, y))


def _off_ties(v: np.ndarray, places: int | None) -> np.ndarray:
    """v rounded as plans' r() rounds: moved a little, since quotients of whole numbers often lie between two results."""
    return v if places is None else np.round(v + 10.0 ** -(places + 3), places)


class _Links:
    """The boxes of one cell, by y0, and which pairs of them are linked."""

    def __init__(self, rows: pa.Table, iou: float, containment: float, by_boxes: bool):
        x0, y0, x1, y1, area = _numbers(rows, *BOX, "area")
        order = np.argsort(y0, kind="stable")
        self.order, self.x0, self.y0, self.x1, self.y1, self.area = order, x0[order], y0[order], x1[order], y1[order], area[order]
        self.size = (self.x1 - self.x0) * (self.y1 - self.y0)
        self.tile = rows.column("tile").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[order]
        self.rank = np.unique(rows.column("id").to_numpy(), return_inverse=True)[1][order]
        self.iou, self.containment, self.by_boxes = iou, containment, by_boxes

    def may(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether each of i overlaps each of j, strictly, in another tile."""
        i = i[:, None]
        out = self.x0[i] < self.x1[j]
        for more in (self.x1[i] > self.x0[j], self.y0[i] < self.y1[j], self.y1[i] > self.y0[j], self.tile[i] != self.tile[j]):
            out &= more
        return out

    def measured(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """intersection, iou, containment and whether it is a link, of overlapping pairs; by masks' areas, which bound the ratios, first."""
        w = np.minimum(self.x1[i], self.x1[j]) - np.maximum(self.x0[i], self.x0[j])
        h = np.minimum(self.y1[i], self.y1[j]) - np.maximum(self.y0[i], self.y0[j])
        inter = np.maximum(w, 0) * np.maximum(h, 0)
        size_i, size_j, area_i, area_j = self.size[i], self.size[j], self.area[i], self.area[j]
        iou, part = _ratio(inter, size_i + size_j - inter), _ratio(inter, np.minimum(size_i, size_j))
        least = np.fmin(area_i, area_j)
        most = np.fmin(least, inter)
        found = (_ratio(most, area_i + area_j - most) >= self.iou) | (_ratio(most, least) >= self.containment)
        if self.by_boxes:
            found &= (iou >= self.iou) | (part >= self.containment)
        return inter, iou, part, found


class _Strips:
    """The masks of one cell, by the number of their box, as strips: a strip has one run of a row at most, so that two of them meet as two
    rows of a matrix. A mask has as many as its rows have runs and, if not all masks fit into one matrix, one set for each band of rows."""

    def __init__(self, rows: pa.Table, order: np.ndarray, dense: int, band: int):
        lists = [rows.column(c).combine_chunks() for c in RUN]
        y, x0, x1 = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        k = np.repeat(place, lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        known = ~(np.isnan(y) | np.isnan(x0) | np.isnan(x1))
        k, y, x0, x1 = k[known], *(c[known].astype(np.int64) for c in (y, x0, x1))
        self.area = np.zeros(len(order), np.int64)
        np.add.at(self.area, k, x1 - x0)
        full = x1 > x0
        by = np.lexsort((y[full], k[full]))
        k, y, x0, x1 = (c[full][by] for c in (k, y, x0, x1))
        self.at = np.zeros(len(order) + 1, np.int64)
        if not len(k):
            return
        y, x0, x1 = y - y.min(), x0 - x0.min(), x1 - x0.min()
        begins = np.r_[True, (k[1:] != k[:-1]) | (y[1:] != y[:-1])]
        layer = np.arange(len(k)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        layers, tall = int(layer.max()) + 1, int(y.max()) + 1
        if len(np.unique(k * layers + layer)) * tall > dense:
            tall = band
        self.bands = int(y.max()) // tall + 1
        self.key, strip = np.unique((k * self.bands + y // tall) * layers + layer, return_inverse=True)
        self.key, y = self.key // layers, y % tall  # of a mask and a band
        self.at = np.searchsorted(self.key, np.arange(len(order) + 1) * self.bands)
        self.one = len(self.key) == len(order) == len(np.unique(self.key // self.bands)) and self.bands == 1
        kind = np.int32 if int(x1.max()) * tall < 1 << 31 else np.int64
        self.low, self.high = np.zeros((2, len(self.key), tall), kind)
        self.low[strip, y], self.high[strip, y] = x0, x1
        self.top, self.bottom = np.full(len(self.key), tall), np.zeros(len(self.key), np.int64)
        np.minimum.at(self.top, strip, y)
        np.maximum.at(self.bottom, strip, y + 1)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pixels that masks i and j share, counted by each pair of runs; i in order."""
        out = np.zeros(len(i), np.int64)
        cuts = [0, *(np.flatnonzero(i[1:] != i[:-1]) + 1).tolist(), len(i)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            for s in range(self.at[i[lo]], self.at[i[lo] + 1]):
                others, rows = j[lo:hi], slice(self.top[s], self.bottom[s])
                if self.one:
                    strips = others
                else:
                    at = others * self.bands + self.key[s] % self.bands
                    first = np.searchsorted(self.key, at)
                    n = np.searchsorted(self.key, at, "right") - first
                    whose = np.repeat(np.arange(hi - lo), n)
                    strips = np.arange(len(whose)) + np.repeat(first - np.cumsum(n) + n, n)
                shared = np.minimum(self.high[strips, rows], self.high[s, rows])
                shared -= np.maximum(self.low[strips, rows], self.low[s, rows])
                got = np.maximum(shared, 0, out=shared).sum(axis=1, dtype=shared.dtype)
                if self.one:
                    out[lo:hi] = got
                else:
                    np.add.at(out, lo + whose, got)
        return out


def _whole(predictions: DataFrame, same: tuple[str, ...], *more: str) -> DataFrame:
    """Rows that can have links: none of what tells them apart is null."""
    return predictions.select("id", "tile", *same, "area", *BOX, *more).dropna(subset=["id", "tile", *same, *BOX])


def links(predictions: DataFrame, side: float, same: tuple[str, ...], iou: float, containment: float, by_boxes: bool = True, kind: str = "double", places: int | None = None, by_masks: bool = False) -> DataFrame:
    """a < b, intersection, iou and containment of boxes that overlap in different tiles and agree in `same`, where a ratio reaches its
    threshold. by_boxes: if not, ratios of boxes needn't, only their bounds by areas. kind: the type of intersections; places: ratios
    are rounded to, off ties. Each pair comes from the cell that holds its intersection's corner.

    by_masks: predictions have a column mask, lists of runs (y, x0, x1), which go with their boxes; the same pairs have the figures of
    their masks, as masks.overlaps() has them. Boxes without runs have no pairs."""

    def kernel(key: tuple, rows: pa.Table) -> Iterator[pa.Table]:
        gx, gy = key[:2]
        fx, fy = (np.floor(v / side) for v in _numbers(rows, "x0", "y0"))
        here = (fx <= gx) & (fy <= gy)
        if by_masks:
            here &= np.nan_to_num(rows.column(RUN[0]).combine_chunks().value_lengths().to_numpy(zero_copy_only=False)) > 0
        rows = rows.filter(pa.array(here))
        if rows.num_rows < 2:
            return
        s = _Links(rows, iou, containment, by_boxes)
        strips = _Strips(rows, s.order, DENSE, BAND) if by_masks else None
        ids = rows.column("id").combine_chunks().take(pa.array(s.order))
        left, top = (fx[here] == gx)[s.order], (fy[here] == gy)[s.order]
        n = len(s.x0)
        for lo in range(0, n, BLOCK):
            i = np.arange(lo, min(n, lo + BLOCK))
            j = np.arange(lo, np.searchsorted(s.y0, s.y1[i].max()))
            if not len(j):
                continue
            pair = s.may(i, j) & (left[i][:, None] | left[j]) & (top[i][:, None] | top[j]) & (j > i[:, None])
            p, q = np.nonzero(pair)
            p, q = i[p], j[q]
            p, q = np.where(s.rank[p] < s.rank[q], p, q), np.where(s.rank[p] < s.rank[q], q, p)
            inter, ious, part, found = s.measured(p, q)
            found &= s.rank[p] != s.rank[q]
            if found.any():
                p, q, common, ious, part = (c[found] for c in (p, q, inter, ious, part))
                if strips:
                    common = strips.common(np.minimum(p, q), np.maximum(p, q))
                    one, two = strips.area[p], strips.area[q]
                    ious, part = _ratio(common, one + two - common), _ratio(common, np.minimum(one, two))
                yield pa.table({"a": ids.take(pa.array(p)), "b": ids.take(pa.array(q)), "intersection": common.astype(np.int64) if whole else common, "iou": _off_ties(ious, places), "containment": _off_ties(part, places)})

    key, whole, more = dict(predictions.dtypes)["id"], kind in ("tinyint", "smallint", "int", "bigint"), ()
    if by_masks:
        # lists of numbers are a third of a list of structs on their way
        predictions, more = predictions.withColumns({c: F.col(f"mask.{c[5:]}") for c in RUN}), RUN
    out = by_cells(_whole(predictions, same, *more), side, same, kernel, f"a {key}, b {key}, intersection {'long' if whole else 'double'}, iou double, containment double")
    return out.withColumn("intersection", F.col("intersection").cast(kind))


def ties(predictions: DataFrame, side: float, same: tuple[str, ...], iou: float, containment: float) -> DataFrame:
    """a, b: a star of what the links() of each cell tie together, by its smallest id. Connected components of these are those of links(),
    but their number grows with the boxes, however many links there are."""

    def kernel(key: tuple, rows: pa.Table) -> Iterator[pa.Table]:
        s = _Links(rows, iou, containment, True)
        n = len(s.x0)
        ids = rows.column("id").combine_chunks().take(pa.array(s.order))
        part, rest = np.full(n, -1), np.arange(n)  # rest: not reached yet, by y0
        tall = np.nan_to_num(s.y1 - s.y0).max()
        for start in range(n):
            if part[start] >= 0:
                continue
            part[start], rest, todo = start, rest[rest != start], np.array([start])
            while len(todo) and len(rest):
                i, todo = todo[-BLOCK:], todo[:-BLOCK]
                lo, hi = np.searchsorted(s.y0[rest], [s.y0[i].min() - tall, s.y1[i].max()])
                near = rest[lo:hi]
                p, q = np.nonzero(s.may(i, near))
                if not len(p):
                    continue
                hit = np.zeros(len(near), bool)
                hit[q[s.measured(i[p], near[q])[3]]] = True
                part[near[hit]] = start
                todo = np.concatenate([todo, near[hit]])
                rest = np.concatenate([rest[:lo], near[~hit], rest[hi:]])
        first = np.full(n, n)
        np.minimum.at(first, part, s.rank)
        at = np.zeros(n, np.int64)
        at[s.rank] = np.arange(n)
        root = at[first[part]]
        star = s.rank != s.rank[root]
        if star.any():
            yield pa.table({"a": ids.take(pa.array(root[star])), "b": ids.filter(pa.array(star))})

    kind = dict(predictions.dtypes)["id"]
    return by_cells(_whole(predictions, same), side, same, kernel, f"a {kind}, b {kind}")


def _decided(box: np.ndarray, inner: np.ndarray, overlap: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float) -> np.ndarray:
    """States of boxes, best first: 2 stays, 1 goes, 0 not known, as that hangs on a box that isn't `inner`: others may be against it.

    open: nothing that is known or unknown is against these so far; doubt: something unknown is, and what these are against is in doubt too."""
    state, doubt, open_ = np.zeros(len(box), np.int64), np.empty(0, np.int64), np.arange(len(box))
    while len(open_):
        best = open_[0]
        if len(doubt) and doubt[0] < best:
            few, doubt = np.split(doubt, [min(BLOCK, int(np.searchsorted(doubt, best)))])
            hit = ((overlap(box[few], box[open_]) > threshold) & (few[:, None] < open_)).any(axis=0)
            doubt, open_ = np.sort(np.concatenate([doubt, open_[hit]])), open_[~hit]
            continue
        open_ = open_[1:]
        if not inner[best]:
            doubt = np.concatenate([[best], doubt])
            continue
        state[best] = 2
        for rest in (open_, doubt):
            state[rest[overlap(box[best : best + 1], box[rest])[0] > threshold]] = 1
        open_, doubt = open_[state[open_] == 0], doubt[state[doubt] == 0]
    return state


def suppressed(boxes: DataFrame, side: float, by: tuple[str, ...], threshold: float, shift: tuple[float, float], overlap: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """boxes (id, score, box, by) with _cells and state: 2 stays, 1 goes, 0 not known yet, for each of its cells. A box of one cell meets all
    that overlap it there; what goes there is left out. What isn't known hangs on boxes that are in more cells than one."""

    def kernel(key: tuple, rows: pa.Table) -> Iterator[pa.Table]:
        score = rows.column("score").to_numpy()
        score = score.astype(np.float64) if score.dtype == object else score
        order = np.lexsort((np.unique(rows.column("id").to_numpy(), return_inverse=True)[1], -score))
        rows = rows.take(pa.array(order))
        inner = rows.column("_cells").to_numpy() == 1
        state = _decided(np.column_stack(_numbers(rows, *BOX)), inner, overlap, threshold)
        out = rows.select(names).append_column("state", pa.array(state))
        yield out.filter(pa.array(~inner | (state != 1)))

    names = [*boxes.columns, "_cells"]
    fields = ", ".join(f"`{c}` {t}" for c, t in boxes.dtypes)
    return by_cells(boxes, side, by, kernel, f"{fields}, _cells long, state long", shift)
