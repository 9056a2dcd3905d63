"""Spatial joins without nested loops: bucketed boxes, radius, exact nearest neighbours, nearest centroid, regions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tesserae.functions.geometry import Box, containment, intersection, iou
from tesserae.session import BROADCAST_ROWS, at_most, dealt, ready, small, written


def _span(lo: Column, hi: Column, bucket: float) -> Column:
    return F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))


def box_overlaps(boxes: DataFrame, bucket: float, key: str = "id", same: tuple[str, ...] = (), residual: Column | None = None) -> DataFrame:
    """Pairs a.key < b.key of boxes (x0..y1) that overlap strictly, as columns with suffixes _a and _b.

    Each box goes to the grid buckets it covers; a pair is made only in the bucket that holds its intersection's corner, so that no
    distinct is needed. `same`: columns that must be equal; residual: a condition over the suffixed columns.
    """
    gx, gy = _span(F.col("x0"), F.col("x1"), bucket), _span(F.col("y0"), F.col("y1"), bucket)
    held = boxes.withColumn("_gx", F.explode(gx)).withColumn("_gy", F.explode(gy))
    names = [c for c in boxes.columns if c not in same]
    keys = ["_gx", "_gy", *same]
    a = held.select(*keys, *[F.col(c).alias(f"{c}_a") for c in names])
    b = held.select(*keys, *[F.col(c).alias(f"{c}_b") for c in names])
    one, two = Box.of(suffix="_a"), Box.of(suffix="_b")
    here = (F.floor(F.greatest(one.x0, two.x0) / bucket) == F.col("_gx")) & (F.floor(F.greatest(one.y0, two.y0) / bucket) == F.col("_gy"))
    on = (F.col(f"{key}_a") < F.col(f"{key}_b")) & one.overlaps(two) & here
    out = a.join(dealt(b), keys).where(on if residual is None else on & residual)
    return out.drop("_gx", "_gy")


def cross_overlaps(left: DataFrame, right: DataFrame, bucket: float, same: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a box of left and one of right that overlap strictly, as columns with suffixes _a and _b; dealt as in box_overlaps()."""
    keys = ["_gx", "_gy", *same]

    def cells(df: DataFrame, suffix: str) -> DataFrame:
        gx, gy = _span(F.col("x0"), F.col("x1"), bucket), _span(F.col("y0"), F.col("y1"), bucket)
        rows = df.withColumn("_gx", F.explode(gx)).withColumn("_gy", F.explode(gy))
        return rows.select(*keys, *[F.col(c).alias(f"{c}{suffix}") for c in df.columns if c not in same])

    one, two = Box.of(suffix="_a"), Box.of(suffix="_b")
    here = (F.floor(F.greatest(one.x0, two.x0) / bucket) == F.col("_gx")) & (F.floor(F.greatest(one.y0, two.y0) / bucket) == F.col("_gy"))
    return cells(left, "_a").join(dealt(cells(right, "_b")), keys).where(one.overlaps(two) & here).drop("_gx", "_gy")


def duplicate_links(boxes: DataFrame, bucket: float, iou_min: float, containment_min: float, key: str = "id", tile: str = "tile", same: tuple[str, ...] = ("class_id",)) -> DataFrame:
    """Links between predictions of different tiles by box overlap: IoU or containment reaches its threshold.

    The bound that areas alone set on both ratios is tested before the ratios."""
    pairs = box_overlaps(boxes, bucket, key, same, F.col(f"{tile}_a") != F.col(f"{tile}_b"))
    a, b = Box.of(suffix="_a"), Box.of(suffix="_b")
    inter = intersection(a, b)
    measured = pairs.withColumn("intersection", inter).withColumn("iou", F.coalesce(F.try_divide("intersection", a.area + b.area - F.col("intersection")), F.lit(0.0))).withColumn("containment", containment(F.col("intersection"), a.area, b.area))
    return measured.where((F.col("iou") >= iou_min) | (F.col("containment") >= containment_min))


def near_places(places: DataFrame, radius: float, order: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of places (x, y and other columns, suffixes _a and _b) within the radius, inclusive, with their distance and `same`, true for a
    row with itself. Each pair is there once, in either direction; rows are told apart by x, y and `order`, which has no nulls.

    Both sides are dealt to grid cells of the radius, a place to its own cell and to four of the eight around it."""
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda v: F.floor(F.col(v) / radius)
    names = places.columns
    b = places.select(*[F.col(c).alias(f"{c}_b") for c in names], cell("x").alias("_cx"), cell("y").alias("_cy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    a = places.select(*[F.col(c).alias(f"{c}_a") for c in names], cell("x").alias("_gx"), cell("y").alias("_gy"), F.explode(around).alias("_o"))
    a = a.withColumn("_cx", F.col("_gx") + F.col("_o.i")).withColumn("_cy", F.col("_gy") + F.col("_o.j")).withColumn("_own", (F.col("_o.i") == 0) & (F.col("_o.j") == 0)).drop("_o", "_gx", "_gy")
    d2 = F.pow(F.col("x_a") - F.col("x_b"), 2) + F.pow(F.col("y_a") - F.col("y_b"), 2)
    one, two = (F.struct(*[F.col(f"{c}_{t}").alias(c) for c in ("x", "y", *order)]) for t in "ab")
    # an exchange of a given number of parts: few places may stand for many pairs, so that their bytes say nothing of the work
    met = a.repartition(parts, "_cx", "_cy").join(dealt(b.repartition(parts, "_cx", "_cy")), ["_cx", "_cy"])
    near = met.where((d2 <= radius * radius) & (~F.col("_own") | (one <= two)))
    return near.select(*[F.col(f"{c}_{t}") for c in names for t in "ab"], F.sqrt(d2).alias("distance"), (F.col("_own") & (one == two)).alias("same"))


def radius_pairs(points: DataFrame, radius: float, key: str = "id", x: str = "x", y: str = "y", carry: tuple[str, ...] = (), where: Column | None = None, measure: Callable[[Column], Column] = lambda d: d) -> DataFrame:
    """a, b, distance of all pairs a < b within the radius, inclusive; columns `carry` of both ends with suffixes _a and _b.

    Points on one place that agree in `carry` are one row with a list, so distances are worked out by places and only then by points.
    where: a condition over carry's columns, x and y with these suffixes, which is the same in both directions. measure: what
    becomes of the distance, also worked out by places."""
    near = near_places(listed(points, key, x, y, carry), radius, ("first",))
    near = (near if where is None else near.where(where)).withColumn("distance", measure(F.col("distance")))
    return pairs_of(near, carry)


def listed(points: DataFrame, key: str = "id", x: str = "x", y: str = "y", carry: tuple[str, ...] = ()) -> DataFrame:
    """Places with the list of points there that agree in `carry`: x, y, carry's columns, ids and the first of these."""
    slim = points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *[F.col(c) for c in carry if c not in ("x", "y")])
    own = [c for c in slim.columns if c != "id"]
    return slim.where("id is not null").groupBy(*own).agg(F.collect_list("id").alias("ids"), F.min("id").alias("first"))


def pairs_of(near: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """a < b, distance and `carry` of both ends: the pairs of points of near_places() of listed()."""
    ends = near.drop("first_a", "first_b").withColumn("i", F.explode("ids_a")).drop("ids_a").withColumn("j", F.explode("ids_b")).drop("ids_b")
    ends = ends.where((F.col("i") < F.col("j")) | (~F.col("same") & (F.col("i") > F.col("j"))))
    ahead = F.col("i") < F.col("j")
    sides = [F.when(ahead, F.col(f"{c}_{s}")).otherwise(F.col(f"{c}_{t}")).alias(f"{c}_{s}") for c in carry for s, t in ("ab", "ba")]
    return ends.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance", *sides)


def knn(points: DataFrame, k: int, bucket: float, key: str = "id", x: str = "x", y: str = "y", rounds: int = 24) -> DataFrame:
    """a, b, rank, distance: the k nearest others of each point, exact, ties by the smaller key.

    Points on one place have the same neighbours but themselves, so places are searched, each by its k + 1 smallest keys, for k + 1
    neighbours. Rings of grid buckets: what a place has found is final once its last distance is within the searched square; the others
    go on with twice the ring. A place whose ring spans all buckets is final too. `bucket` is the largest side to begin with: where
    points are dense, smaller ones hold enough.
    """
    slim = written(points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "points")
    total = slim.count()
    lo_x, hi_x, lo_y, hi_y = (v or 0.0 for v in slim.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())
    least = slim.withColumn("_k", F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))).where(F.col("_k") <= k + 1)
    places = written(least.groupBy("x", "y").agg(F.sort_array(F.collect_list("id")).alias("ids")), "places")
    todo, done, side = places.select("x", "y"), None, float(bucket)
    while total and side * side * total > 8 * (k + 1) * (hi_x - lo_x) * (hi_y - lo_y) > 0:
        side, rounds = side / 2, rounds + 1
    for _ in range(rounds):
        cell = lambda v: F.floor(F.col(v) / side)  # noqa: E731, B023
        b = places.select("ids", F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("_cx"), cell("y").alias("_cy"))
        around = F.array(F.lit(-1), F.lit(0), F.lit(1))
        a = todo.select("x", "y", cell("x").alias("_gx"), cell("y").alias("_gy"), F.explode(around).alias("_dx")).withColumn("_dy", F.explode(around))
        a = a.select("x", "y", "_gx", "_gy", (F.col("_gx") + F.col("_dx")).alias("_cx"), (F.col("_gy") + F.col("_dy")).alias("_cy"))
        d2 = F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2)
        rank = F.row_number().over(Window.partitionBy("x", "y").orderBy("d2", "b"))
        near = a.join(dealt(b), ["_cx", "_cy"]).select(F.explode("ids").alias("b"), d2.alias("d2"), "x", "y", "_gx", "_gy").withColumn("rank", rank).where(F.col("rank") <= k + 1)
        # the searched square reaches at least this far from the place
        reach = F.least(F.col("x") - (F.col("_gx") - 1) * side, (F.col("_gx") + 2) * side - F.col("x"), F.col("y") - (F.col("_gy") - 1) * side, (F.col("_gy") + 2) * side - F.col("y"))
        whole = side >= max(hi_x - lo_x, hi_y - lo_y, 0.0)
        last = near.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("d2", "b"))).alias("found"), F.min(reach).alias("reach"))
        worst = F.array_max("found")["d2"]
        last = written(last.withColumn("final", F.lit(whole) | ((F.size("found") >= min(k + 1, total)) & (worst < F.col("reach") * F.col("reach")))), "near")
        part = last.where("final").select("x", "y", "found")
        done = part if done is None else done.unionAll(part)
        if whole:
            break
        todo = written(last.where("not final").select("x", "y"), "todo")
        if at_most(todo, 0):
            break
        side *= 2
    else:
        raise RuntimeError(f"neighbours aren't found after {rounds} rounds: give a larger bucket")
    others = F.slice(F.filter("found", lambda s: s["b"] != F.col("id")), 1, k)
    rows = slim.join(dealt(done), ["x", "y"]).select(F.col("id").alias("a"), F.posexplode(others).alias("at", "s"))
    return rows.select("a", F.col("s.b").alias("b"), (F.col("at") + 1).alias("rank"), F.sqrt("s.d2").alias("distance"))


def knn_vectors(points: DataFrame, k: int, key: str = "id", vector: str = "vector", block: int = 64) -> DataFrame:
    """a, b, rank, distance: the k nearest others of each vector, exact, ties by place in key order. The vectors, which are counted,
    travel to all tasks; a task holds block x vectors distances at a time."""
    if not at_most(points, BROADCAST_ROWS):
        raise ValueError("too many vectors for a search of all: sample them")
    rows = points.select(key, vector).orderBy(key).collect()
    ids, every = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    shared = points.sparkSession.sparkContext.broadcast((np.array(ids), every, (every * every).sum(axis=1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, all_, norms = shared.value
        for b in batches:
            own, vectors = b["key"].to_numpy(), np.stack(b["vector"].to_numpy()) if len(b) else np.empty((0, 0))
            for lo in range(0, len(own), block):
                v, names = vectors[lo : lo + block], own[lo : lo + block]
                d = np.maximum((v * v).sum(axis=1)[:, None] - 2 * v @ all_.T + norms, 0)
                d[keys[None, :] == names[:, None]] = np.inf
                m = min(k, len(keys) - 1)
                at = np.argsort(d, axis=1, kind="stable")[:, :m]
                far = np.sqrt(np.take_along_axis(d, at, 1))
                yield pd.DataFrame({"a": np.repeat(names, m), "b": keys[at.ravel()], "rank": np.tile(np.arange(1, m + 1), len(names)), "distance": far.ravel()})

    ready(points.sparkSession)
    kind = dict(points.dtypes)[key]
    return points.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInPandas(run, f"a {kind}, b {kind}, rank int, distance double")


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, key: str = "id", vector: str = "vector", label: str = "label") -> DataFrame:
    """key, label and squared distance of the nearest centroid, ties by the lower label. The centroids, which are counted, travel to
    the vectors: an Arrow batch is one matrix product."""
    rows = centroids.select(label, vector).limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("too many centroids for one matrix")
    rows.sort(key=lambda r: r[0])
    labels, c = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.stack(b["vector"].to_numpy()).astype(np.float64)
                d = ((v * v).sum(axis=1)[:, None] - 2 * v @ c.T) + (c * c).sum(axis=1)
                k = d.argmin(axis=1)
                exact = ((v - c[k]) ** 2).sum(axis=1)
                yield pd.DataFrame({"key": b["key"], "label": labels[k], "d2": exact})

    ready(vectors.sparkSession)
    kind = dict(vectors.dtypes)[key]
    out = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInPandas(assign, f"key {kind}, label {dict(centroids.dtypes)[label]}, d2 double")
    return out.select(F.col("key").alias(key), "label", "d2")


def in_regions(points: DataFrame, regions: DataFrame, bucket: float, x: str = "x", y: str = "y", inclusive: bool = False) -> DataFrame:
    """points joined with the regions (x0..y1) that hold them. A small, counted side of regions is broadcast, else both are bucketed."""
    box = Box.of()
    px, py = F.col(x), F.col(y)
    on = (px >= box.x0) & (py >= box.y0) & ((px <= box.x1) & (py <= box.y1) if inclusive else (px < box.x1) & (py < box.y1))
    held = regions.withColumn("_gx", F.explode(_span(F.col("x0"), F.col("x1"), bucket))).withColumn("_gy", F.explode(_span(F.col("y0"), F.col("y1"), bucket)))
    cells = points.withColumn("_gx", F.floor(px / bucket)).withColumn("_gy", F.floor(py / bucket))
    return cells.join(small(held), ["_gx", "_gy"]).where(on).drop("_gx", "_gy")


def nearest_point(points: DataFrame, x: float, y: float, radius: float, key: str = "id", px: str = "x", py: str = "y") -> DataFrame:
    """The nearest row within the radius, ties by key; none if there is none."""
    d2 = F.pow(F.col(px) - x, 2) + F.pow(F.col(py) - y, 2)
    near = points.where(F.col(px).between(x - radius, x + radius) & F.col(py).between(y - radius, y + radius)).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    return near.orderBy("d2", key).limit(1)


def match_labels(gt: DataFrame, pred: DataFrame, low: float, high: float, group: str = "image", allow_low_quality: bool = False, bucket: float = 128) -> DataFrame:
    """Best ground truth of each prediction by IoU, labelled 1 from `high`, 0 below `low`, -1 between; ties go to the smaller gt.

    Boxes meet in grid buckets; a prediction that overlaps nothing has the group's first ground truth, at 0.
    allow_low_quality: the best predictions of each ground truth, ties included, are 1 as well."""
    box = ["x0", "y0", "x1", "y1"]
    met = cross_overlaps(gt.select(group, F.col("id").alias("gt"), *box), pred.select(group, F.col("id").alias("pred"), *box), bucket, (group,))
    pairs = met.select(group, F.col("pred_b").alias("pred"), F.col("gt_a").alias("gt"), F.coalesce(iou(Box.of(suffix="_a"), Box.of(suffix="_b")), F.lit(0.0)).alias("iou"))
    first = gt.groupBy(group).agg(F.min("id").alias("gt"))
    every = pred.select(group, F.col("id").alias("pred")).join(small(first), group, "left").select(group, "pred", "gt", F.lit(0.0).alias("iou"))
    best = pairs.unionAll(every).groupBy(group, "pred").agg(F.max(F.struct("iou", (-F.col("gt")).alias("neg"))).alias("m"))
    out = best.select(group, "pred", (-F.col("m.neg")).alias("gt"), F.col("m.iou").alias("iou"))
    label = F.when(F.col("iou") >= high, 1).when(F.col("iou") < low, 0).otherwise(-1)
    if not allow_low_quality:
        return out.withColumn("match_label", label)
    top = pairs.withColumn("_top", F.max("iou").over(Window.partitionBy(group, "gt"))).where((F.col("iou") == F.col("_top")) & (F.col("iou") > 0)).select(group, "pred").distinct().withColumn("_low", F.lit(True))
    return out.join(top, [group, "pred"], "left").withColumn("match_label", F.when(F.col("_low"), 1).otherwise(label)).drop("_low")
