"""Masks as runs: rows (id, y, x0, x1), x1 beyond the run. Overlap, union, area, box, centroid and painting stay relational."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tesserae.session import dealt, ready


def to_runs(pixels: DataFrame, id_: str = "id", y: str = "y", x: str = "x") -> DataFrame:
    """Runs of pixels: neighbours in a row share x minus their rank."""
    rank = F.row_number().over(Window.partitionBy(id_, y).orderBy(x))
    rows = pixels.select(id_, y, x).distinct().withColumn("_g", F.col(x) - rank)
    return rows.groupBy(id_, y, "_g").agg(F.min(x).alias("x0"), (F.max(x) + 1).alias("x1")).drop("_g")


def to_pixels(runs: DataFrame) -> DataFrame:
    return runs.where("x1 > x0").withColumn("x", F.explode(F.sequence("x0", F.col("x1") - 1))).drop("x0", "x1")


def unpack(archives: DataFrame) -> DataFrame:
    """Runs of bit-packed masks (id, x, y, width, height, data): bits little-endian, row by row, from the box's corner."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                bits = np.unpackbits(np.frombuffer(r.data, np.uint8), bitorder="little")[: r.width * r.height].reshape(r.height, r.width)
                edge = np.diff(np.pad(bits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                ys, starts = np.nonzero(edge == 1)
                _, ends = np.nonzero(edge == -1)
                out.append(pd.DataFrame({"id": r.id, "y": ys + r.y, "x0": starts + r.x, "x1": ends + r.x}))
            yield pd.concat(out) if out else pd.DataFrame({"id": [], "y": [], "x0": [], "x1": []})

    ready(archives.sparkSession)
    kind = dict(archives.dtypes)["id"]
    return archives.select("id", "x", "y", "width", "height", "data").mapInPandas(run, f"id {kind}, y long, x0 long, x1 long")


def pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits.astype(bool).ravel(), bitorder="little").tobytes()


def measured(archives: DataFrame) -> DataFrame:
    """Bit-packed masks (x, y, width, height, data, and other columns, which stay) with the area and the corner (x0, y0) of their pixels, read
    from the bits as they stand; masks without a pixel are left out."""
    names = [c for c in archives.columns if c not in ("x", "y", "width", "height", "data")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y, w, h, data in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: w * h].reshape(h, w)
                n = int(np.count_nonzero(bits))
                out.append((n, x + int(np.bitwise_or.reduce(bits, axis=0).argmax()), y + int(bits.argmax()) // w) if n else (0, 0, 0))
            found = np.array(out, np.int64).reshape(-1, 3)
            own = [b.column(k) for k in range(5, b.num_columns)] + [pa.array(c) for c in found.T]
            yield pa.RecordBatch.from_arrays(own, [*names, "area", "x0", "y0"]).filter(pa.array(found[:, 0] > 0))

    ready(archives.sparkSession)
    fields = "".join(f"`{c}` {dict(archives.dtypes)[c]}, " for c in names)
    return archives.select("x", "y", "width", "height", "data", *names).mapInArrow(run, f"{fields}area long, x0 long, y0 long")


#: Bits that packed() holds unpacked at a time, unless one mask has more.
BITS = 1 << 22


def packed(rows: DataFrame) -> DataFrame:
    """rows with a column mask (a list of y, x0, x1: the runs of one mask), in its place area, box, centroid, as statistics() has them, width,
    height and data, the bits that unpack() reads. A mask is packed where it is, and those without a pixel are left out."""
    names = [c for c in rows.columns if c != "mask"]
    made = ["area", *(box := ["x0", "y0", "x1", "y1"]), "centroid_x", "centroid_y", "width", "height", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(0)
            y, x0, x1 = (held.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("y", "x0", "x1"))
            k = np.repeat(np.arange(b.num_rows), [n or 0 for n in held.value_lengths().to_pylist()])
            full = (x1 > x0) & (y == y)  # noqa: PLR0124: nor unknown
            k, y, x0, x1 = k[full], *(c[full].astype(np.int64) for c in (y, x0, x1))
            at, first, k = np.unique(k, return_index=True, return_inverse=True)  # masks that have pixels, and where their runs begin
            if not len(at):
                continue
            n = x1 - x0
            area, low, high, top, bottom = (f.reduceat(v, first) for f, v in ((np.add, n), (np.minimum, x0), (np.maximum, x1), (np.minimum, y), (np.maximum, y)))
            cx, cy = (np.add.reduceat(v, first) / area for v in (n * (x0 + x1 - 1) / 2, (n * y).astype(float)))
            width, height = high - low, bottom + 1 - top
            octets = -(-width * height // 8)
            place = (y - top[k]) * width[k] + x0 - low[k]
            ends, cuts, lo = np.cumsum(octets), [], 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BITS // 8, "right")))
                cuts.append((lo, hi))
                lo = hi
            for lo, hi in cuts:
                here = slice(first[lo], first[hi] if hi < len(at) else len(k))
                base = np.cumsum([0, *octets[lo:hi]])
                start = place[here] + 8 * base[k[here] - lo]
                change = np.zeros(8 * base[-1] + 1, np.int32)
                np.add.at(change, start, np.int32(1))
                np.add.at(change, start + n[here], np.int32(-1))
                bits = np.packbits(np.cumsum(change, out=change)[:-1] > 0, bitorder="little")
                data = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(base.astype(np.int32)), pa.py_buffer(bits)])
                values = [pa.array(c[lo:hi]) for c in (area, low, top, high, bottom + 1, cx, cy)] + [pa.array(c[lo:hi].astype(np.int32)) for c in (width, height)]
                own = b.take(pa.array(at[lo:hi]))
                yield pa.RecordBatch.from_arrays([own.column(i) for i in range(1, b.num_columns)] + values + [data], [*names, *made])

    ready(rows.sparkSession)
    fields = "".join(f"`{c}` {dict(rows.dtypes)[c]}, " for c in names)
    return rows.select("mask", *names).mapInArrow(run, f"{fields}area long, {', '.join(f'{c} long' for c in box)}, centroid_x double, centroid_y double, width int, height int, data binary")


def statistics(runs: DataFrame) -> DataFrame:
    """id, area, box (x0 .. y1) and centroid (mean of pixel places), from runs in closed form."""
    n = F.col("x1") - F.col("x0")
    return runs.groupBy("id").agg(
        F.sum(n).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"),
        (F.sum(n * (F.col("x0") + F.col("x1") - 1) / 2) / F.sum(n)).alias("centroid_x"), (F.sum(n * F.col("y")) / F.sum(n)).alias("centroid_y"),
    )


def lists(runs: DataFrame) -> DataFrame:
    """id and mask: its runs as a list."""
    return runs.groupBy("id").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("mask"))


def overlaps(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with intersection, iou and containment of their masks: an interval join within equal rows of the image. Its rows are those
    of pairs times those of a mask; reconcile.links() and reconcile.overlaps() measure masks where pairs of boxes are made."""
    one = runs.select(F.col("id").alias("a"), "y", F.col("x0").alias("s1"), F.col("x1").alias("e1"))
    two = runs.select(F.col("id").alias("b"), "y", F.col("x0").alias("s2"), F.col("x1").alias("e2"))
    common = F.greatest(F.lit(0), F.least("e1", "e2") - F.greatest("s1", "s2"))
    inter = pairs.select("a", "b").join(dealt(one), "a").join(dealt(two), ["b", "y"]).groupBy("a", "b").agg(F.sum(common).alias("intersection"))
    area = runs.groupBy("id").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
    out = pairs.join(dealt(inter), ["a", "b"], "left").withColumn("intersection", F.coalesce("intersection", F.lit(0).cast("long")))
    out = out.join(dealt(area.select(F.col("id").alias("a"), F.col("area").alias("area_a"))), "a").join(dealt(area.select(F.col("id").alias("b"), F.col("area").alias("area_b"))), "b")
    i = F.col("intersection")
    return out.withColumn("iou", F.coalesce(F.try_divide(i, F.col("area_a") + F.col("area_b") - i), F.lit(0.0))).withColumn("containment", F.coalesce(F.try_divide(i, F.least("area_a", "area_b")), F.lit(0.0)))


def union(runs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Runs of the union of each group's masks; groups: id, group, or None if runs have their group as a column. Overlapping runs of a row melt
    by a running maximum; of those that begin on one pixel only the longest travels to it."""
    held = runs if groups is None else runs.join(dealt(groups), "id")
    rows = held.groupBy("group", "y", "x0").agg(F.max("x1").alias("x1"))
    w = Window.partitionBy("group", "y").orderBy("x0", "x1")
    fresh = F.col("x0") > F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("_k", F.sum("_new").over(w))
    return marked.groupBy("group", "y", "_k").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).select(F.col("group").alias("id"), "y", "x0", "x1")


def paint_runs(runs: DataFrame, scores: DataFrame, rows: int = 64, columns: int = 4096) -> DataFrame:
    """y, x0, x1, label, n: where masks overlap the higher score, ties to the smaller id, has the pixel; n is how many claimed it.

    Runs travel as they are, cut where they leave a cell of rows x columns pixels; a cell is painted by itself, the best mask last."""
    cell = F.explode(F.sequence(F.floor(F.col("x0") / columns), F.floor((F.col("x1") - 1) / columns))).alias("_cx")
    dealt = runs.where("x1 > x0").join(scores.select("id", "score"), "id").select(F.floor(F.col("y") / rows).alias("_cy"), cell, "y", "x0", "x1", "id", F.col("score").cast("double").alias("score"))
    cut = dealt.withColumn("x0", F.greatest("x0", F.col("_cx") * columns)).withColumn("x1", F.least("x1", (F.col("_cx") + 1) * columns))
    names = ["_cy", "_cx", "y", "x0", "x1", "id"]
    schema = pa.schema([(c, pa.int64()) for c in ("y", "x0", "x1", "label", "n")])

    def segments(cell: tuple[int, int], label: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
        n = np.cumsum(change, axis=1)[:, :columns]
        edge = np.ones((rows, columns), bool)
        edge[:, 1:] = (label[:, 1:] != label[:, :-1]) | (n[:, 1:] != n[:, :-1])
        at = np.flatnonzero(edge.ravel())
        ends = np.append(at[1:], rows * columns)
        full = n.ravel()[at] > 0
        at, ends = at[full], ends[full]
        y, x = at // columns + cell[0] * rows, at % columns + cell[1] * columns
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (y, x, x + ends - at, label.ravel()[at], n.ravel()[at])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            cuts = [0, *(np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                cy, cx, y, x0, x1, ids = (c[lo:hi] for c in cols)
                if (key := (int(cy[0]), int(cx[0]))) != cell:
                    if cell is not None:
                        yield segments(cell, label, change)
                    cell, label, change = key, np.zeros((rows, columns), np.int64), np.zeros((rows, columns + 1), np.int32)
                y, x0, x1 = y - cell[0] * rows, x0 - cell[1] * columns, x1 - cell[1] * columns
                np.add.at(change, (y, x0), 1)
                np.add.at(change, (y, x1), -1)
                for r, p, q, i in zip(y.tolist(), x0.tolist(), x1.tolist(), ids.tolist(), strict=True):
                    label[r, p:q] = i
        if cell is not None:
            yield segments(cell, label, change)

    ready(runs.sparkSession)
    ordered = cut.repartition("_cy", "_cx").sortWithinPartitions("_cy", "_cx", "score", F.desc("id"))
    return ordered.select(*[F.col(c).cast("long").alias(c) for c in names]).mapInArrow(run, "y long, x0 long, x1 long, label long, n long")


def paint(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """paint_runs() by the pixel: y, x, label, n."""
    return to_pixels(paint_runs(runs, scores)).select("y", "x", "label", "n")


def conflicts(painted: DataFrame) -> DataFrame:
    return painted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("conflicts"), F.count("*").alias("pixels"))


def from_polygons(shapes: DataFrame) -> DataFrame:
    """Runs of polygons (id, xs, ys; several rows of an id are parts of one shape): pixels whose centre is inside by the even-odd rule.

    Each edge gives the places where it crosses rows' middles; a row's crossings, in order, open and close runs."""
    n = F.size("xs")
    ends = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("xs", i).alias("ax"), F.get("ys", i).alias("ay"), F.get("xs", (i + 1) % n).alias("bx"), F.get("ys", (i + 1) % n).alias("by")))
    edges = shapes.where(n >= 3).select("id", F.explode(ends).alias("e")).select("id", "e.*").where("ay <> by")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    # rows whose middle lies in [low, high)
    rows = edges.select("*", F.ceil(low - 0.5).alias("_first"), (F.ceil(high - 0.5) - 1).alias("_last")).where("_first <= _last")
    at = rows.select("id", F.explode(F.sequence("_first", "_last")).alias("y"), "ax", "ay", "bx", "by")
    cross = at.select("id", "y", (F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))).alias("c"))
    lists = cross.groupBy("id", "y").agg(F.sort_array(F.collect_list("c")).alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1), lambda i: F.struct(F.ceil(F.get("c", 2 * i) - 0.5).alias("x0"), F.ceil(F.get("c", 2 * i + 1) - 0.5).alias("x1")))
    return lists.select("id", "y", F.explode(pairs).alias("r")).select("id", "y", "r.x0", "r.x1").where("x1 > x0")


def polygons(runs: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """id, xs, ys, area and box of each mask's largest outline, simplified to tolerance x perimeter; masks whose outline has fewer than
    three corners or no area are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tesserae.operators.raster import outline, simplify

        x, y = int(pdf["x0"].min()), int(pdf["y"].min())
        bits = np.zeros((int(pdf["y"].max()) - y + 1, int(pdf["x1"].max()) - x), bool)
        for r in pdf.itertuples(index=False):
            bits[r.y - y, r.x0 - x : r.x1 - x] = True
        p = simplify(outline(bits), tolerance)
        area = 0.5 * abs(float(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1)))) if len(p) > 2 else 0.0
        if area == 0:
            return pd.DataFrame(columns=["id", "xs", "ys", "area"])
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "xs": [(p[:, 0] + x).astype(float).tolist()], "ys": [(p[:, 1] + y).astype(float).tolist()], "area": [area]})

    ready(runs.sparkSession)
    out = runs.groupBy("id").applyInPandas(run, f"id {dict(runs.dtypes)['id']}, xs array<double>, ys array<double>, area double")
    w = lambda a: F.array_max(a) - F.array_min(a)
    return out.withColumn("bbox", F.array(F.array_min("xs"), F.array_min("ys"), w("xs"), w("ys")))
