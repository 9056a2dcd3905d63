"""Filters and picks over detected instances, keypoints, centres and uncertain points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tesserae.functions.geometry import Box, iou
from tesserae.operators.matching import nms


def nonempty(instances: DataFrame, threshold: float = 1e-5, by_mask: bool = False) -> DataFrame:
    """Instances whose box, and mask if asked for, has an extent."""
    out = instances.where(Box.of().nonempty(threshold))
    return out.where("area > 0") if by_mask else out


def foreground(proposals: DataFrame, background: int, label: str = "class") -> DataFrame:
    return proposals.where((F.col(label) != -1) & (F.col(label) != background))


def with_visible_keypoint(proposals: DataFrame, keypoints: DataFrame, key: str = "id") -> DataFrame:
    """Proposals with a visible keypoint (key, kx, ky, v) in or on their box: a semi-join with a range condition."""
    pts = keypoints.where("v >= 1").select(F.col(key).alias("_k"), "kx", "ky")
    inside = (F.col("kx") >= F.col("x0")) & (F.col("kx") <= F.col("x1")) & (F.col("ky") >= F.col("y0")) & (F.col("ky") <= F.col("y1"))
    return proposals.join(pts, (F.col(key) == F.col("_k")) & inside, "left_semi")


def consistent(rows: DataFrame, keys: list[str]) -> Column:
    """Whether each of keys has one value in rows: for an aggregate over datasets' metadata."""
    out = F.lit(True)
    for k in keys:
        out = out & (F.count_distinct(k) <= 1)
    return out.alias("consistent")


def detections(scored: DataFrame, score: float, overlap: float, limit: int, image: str = "image", label: str = "class_id") -> DataFrame:
    """Detections above the score, suppressed within a class, the best `limit` of each image."""
    kept = nms(scored.where(F.col("score") > score), overlap, [image, label])
    rank = F.row_number().over(Window.partitionBy(image).orderBy(F.desc("score"), "id"))
    return kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)


def matched_iou(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """IoU of boxes with the same key."""
    a = left.select(key, *[F.col(c).alias(f"{c}_a") for c in ("x0", "y0", "x1", "y1")])
    b = right.select(key, *[F.col(c).alias(f"{c}_b") for c in ("x0", "y0", "x1", "y1")])
    return a.join(b, key).select(key, iou(Box.of(suffix="_a"), Box.of(suffix="_b")).alias("iou"))


def centers(heat: DataFrame, threshold: float, reach: int, k: int, image: str = "image") -> DataFrame:
    """Local maxima of a heat map (image, y, x, value): not below any value within reach, above the threshold, the best k.

    Only pixels over the threshold take part; each is offered to its neighbours and compared with the largest offer."""
    hot = heat.where(F.col("value") > threshold)
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)])
    offers = hot.select(image, "value", F.explode(offsets).alias("o"), "y", "x").select(image, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "value")
    top = offers.groupBy(image, "y", "x").agg(F.max("value").alias("_top"))
    rank = F.row_number().over(Window.partitionBy(image).orderBy(F.desc("value"), "y", "x"))
    return hot.join(top, [image, "y", "x"]).where("value >= _top").drop("_top").withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def nearest_center(pixels: DataFrame, centers_: DataFrame, image: str = "image") -> DataFrame:
    """Each pixel's nearest centre of its image, ties to the smaller id: centres of an image are few and travel as one array."""
    lists = centers_.groupBy(image).agg(F.collect_list(F.struct("id", "cy", "cx")).alias("_c"))
    d2 = lambda c: F.pow(F.col("y") - c["cy"], 2) + F.pow(F.col("x") - c["cx"], 2)
    best = F.array_min(F.transform("_c", lambda c: F.struct(d2(c).alias("d2"), c["id"].alias("id"))))
    return pixels.join(lists, image).withColumn("center", best["id"]).drop("_c")


def uncertain_points(points: DataFrame, k: int, by: str, share: float = 0.75, draw: Column | None = None) -> DataFrame:
    """The int(share x k) points nearest to indecision (|logit| smallest) of each group, and others by draw up to k."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.abs("logit"), "id"))
    rows = points.withColumn("_k", rank)
    first = int(share * k)
    sure = rows.where(F.col("_k") <= first)
    rest = rows.where(F.col("_k") > first).withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(draw if draw is not None else F.xxhash64("id"), "id")))
    return sure.unionByName(rest.where(F.col("_k") <= k - first)).drop("_k")


def boundary_iou(matrix: DataFrame) -> DataFrame:
    """IoU by class of rows (class, in_gt, in_pred, n) of boundary pixels."""
    both = F.sum(F.when(F.col("in_gt") & F.col("in_pred"), F.col("n")).otherwise(0))
    any_ = F.sum(F.when(F.col("in_gt") | F.col("in_pred"), F.col("n")).otherwise(0))
    return matrix.groupBy("class").agg(F.try_divide(both, any_).alias("iou"))
