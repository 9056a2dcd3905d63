"""Detection and segmentation metrics from relational parts: windows for curves, sums for matrices, per-image kernels for greedy
matching."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tesserae.functions.geometry import Box, intersection
from tesserae.operators.joins import cross_overlaps
from tesserae.session import at_most, ready, small, written

IOU_STEPS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
RECALL_STEPS = tuple(round(0.01 * k, 2) for k in range(101))


def confusion(rows: DataFrame, gt: str, pred: str, classes: int, ignore: int | None = None) -> DataFrame:
    """gt, pred and number of pixels; an ignored ground truth counts as class `classes`."""
    g = F.col(gt) if ignore is None else F.when(F.col(gt) == ignore, classes).otherwise(F.col(gt))
    return rows.groupBy(g.alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def segmentation_scores(matrix: DataFrame, classes: int) -> DataFrame:
    """mIoU, fwIoU, mACC and pACC in percent from a confusion matrix of classes squared cells."""
    tp = matrix.where(f"gt = pred and gt < {classes}").select(F.col("gt").alias("c"), F.col("n").alias("tp"))
    pos = matrix.where(f"gt < {classes} and pred < {classes}").groupBy(F.col("gt").alias("c")).agg(F.sum("n").alias("pos"))
    got = matrix.where(f"gt < {classes} and pred < {classes}").groupBy(F.col("pred").alias("c")).agg(F.sum("n").alias("got"))
    each = pos.join(got, "c", "full").join(tp, "c", "left").na.fill(0)
    union = F.col("pos") + F.col("got") - F.col("tp")
    rows = each.withColumn("acc", F.when(F.col("pos") > 0, F.col("tp") / F.col("pos"))).withColumn("iou", F.when((F.col("pos") > 0) & (union > 0), F.col("tp") / union))
    total = F.sum("pos")
    return rows.agg((100 * F.avg("iou")).alias("miou"), (100 * F.sum(F.col("iou") * F.col("pos")) / total).alias("fwiou"), (100 * F.avg("acc")).alias("macc"), (100 * F.sum("tp") / total).alias("pacc"))


def class_scores(matrix: DataFrame, classes: int) -> DataFrame:
    """IoU and accuracy of each class, null where a class doesn't occur."""
    inner = matrix.where(f"gt < {classes} and pred < {classes}")
    each = inner.select(F.col("gt").alias("c"), "n", F.lit(1).alias("g"), (F.col("gt") == F.col("pred")).cast("int").alias("t")).unionAll(inner.select(F.col("pred").alias("c"), "n", F.lit(0).alias("g"), F.lit(0).alias("t")))
    sums = each.groupBy("c").agg(F.sum(F.col("n") * F.col("g")).alias("pos"), F.sum(F.col("n") * (1 - F.col("g"))).alias("got"), F.sum(F.col("n") * F.col("t")).alias("tp"))
    return sums.select("c", F.try_divide("tp", F.col("pos") + F.col("got") - F.col("tp")).alias("iou"), F.try_divide("tp", "pos").alias("acc"))


def voc_best(gt: DataFrame, det: DataFrame, over: float, pad: float = 1.0, bucket: float = 128.0) -> DataFrame:
    """image, class, det, score, gt, hard, ov of each detection whose best ground truth of its image and class overlaps by more than
    `over` (0 or more). Only boxes that overlap meet, in buckets."""
    box = lambda df: df.withColumn("x1", F.col("x1") + pad).withColumn("y1", F.col("y1") + pad)
    a = box(gt.select("image", "class", "id", "difficult", "x0", "y0", "x1", "y1"))
    b = box(det.select("image", "class", "id", "score", "x0", "y0", "x1", "y1"))
    one, two = Box.of(suffix="_a"), Box.of(suffix="_b")
    inter = intersection(one, two)
    pairs = cross_overlaps(a, b, bucket, ("image", "class")).withColumn("ov", inter / (one.area + two.area - inter)).where(F.col("ov") > over)
    best = pairs.groupBy("image", "class", F.col("id_b").alias("det")).agg(F.max(F.struct("ov", (-F.col("id_a")).alias("neg"), F.col("difficult_a").alias("hard"))).alias("m"), F.first("score_b").alias("score"))
    return best.select("image", "class", "det", "score", (-F.col("m.neg")).alias("gt"), F.coalesce("m.hard", F.lit(False)).alias("hard"), "m.ov")


def voc_matches(gt: DataFrame, det: DataFrame, threshold: float, pad: float = 1.0, bucket: float = 128.0) -> DataFrame:
    """det with tp: the best ground truth of its image and class, if over the threshold, claimed once by the highest score. Difficult
    ones neither help nor hurt. gt: image, class, id, difficult, box; det: image, class, id, score, box; pad counts pixels inclusive."""
    return _claimed(det, voc_best(gt, det, threshold, pad, bucket).withColumn("iou_step", F.lit(threshold)), (threshold,)).drop("iou_step")


def _claimed(det: DataFrame, hit: DataFrame, steps: tuple[float, ...]) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("iou_step", "image", "class", "gt").orderBy(F.desc("score"), "det"))
    claimed = hit.select("iou_step", "image", "class", "det", "hard", (turn == 1).alias("first"))
    every = det.select("image", "class", F.col("id").alias("det"), "score").withColumn("iou_step", F.explode(F.array(*[F.lit(float(t)) for t in steps])))
    rows = every.join(claimed, ["iou_step", "image", "class", "det"], "left")
    return rows.where(~F.coalesce("hard", F.lit(False))).select("iou_step", "image", "class", "det", "score", F.coalesce("first", F.lit(False)).alias("tp"))


def voc_report(gt: DataFrame, det: DataFrame, steps: tuple[float, ...] = IOU_STEPS, pad: float = 1.0) -> DataFrame:
    """class, iou_step, ap, ap11 at thresholds from 0.50 to 0.95. Scores count to three places and boxes to one, as they are submitted.

    A detection's best ground truth is the same at every threshold, so pairs are made once."""
    held = det.withColumn("score", F.round("score", 3)).withColumns({c: F.round(F.col(c).cast("double"), 1) for c in BOX})
    best = voc_best(gt, held, min(steps), pad)
    hit = best.withColumn("iou_step", F.explode(F.array(*[F.lit(float(t)) for t in steps]))).where(F.col("ov") > F.col("iou_step")).drop("ov")
    rows = _claimed(held, hit, steps).withColumn("key", F.struct("class", "iou_step"))
    positives = gt.groupBy("class").agg(F.count_if(~F.coalesce("difficult", F.lit(False))).alias("npos"))
    keys = positives.withColumn("iou_step", F.explode(F.array(*[F.lit(float(t)) for t in steps]))).select(F.struct("class", "iou_step").alias("key"), "npos")
    return average_precision(precision_recall(rows, keys, "key"), "key").select("key.class", "key.iou_step", "ap", "ap11")


def precision_recall(matches: DataFrame, positives: DataFrame, by: str = "class") -> DataFrame:
    """Running precision and recall by falling score (ties by det), with the envelope: the best precision at this recall or beyond.

    A class may hold a third of all rows, so none is one task's: rows are range-partitioned by class and score, sums run within a
    partition, and what stands before or after it comes from one row a class and partition."""
    order = [F.desc("score"), F.col("det")]
    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(matches.join(positives, by).repartitionByRange(parts, by, *order).withColumn("_p", F.spark_partition_id()), "matches")
    sums = rows.groupBy(by, "_p").agg(F.sum(F.col("tp").cast("long")).alias("_t"), F.count("*").alias("_c"))
    earlier = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(by, "_p", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c0"))
    own = Window.partitionBy(by, "_p").orderBy(*order)
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    tp, n = F.sum(F.col("tp").cast("long")).over(run) + F.col("_t0"), F.count("*").over(run) + F.col("_c0")
    joined = rows.join(F.broadcast(before) if at_most(before) else before, [by, "_p"])
    curve = written(joined.withColumn("precision", tp / n).withColumn("recall", F.try_divide(tp, "npos")).drop("_t0", "_c0"), "curve")
    later = Window.partitionBy(by).orderBy("_p").rowsBetween(1, Window.unboundedFollowing)
    after = curve.groupBy(by, "_p").agg(F.max("precision").alias("_m")).select(by, "_p", F.max("_m").over(later).alias("_best"))
    rest = F.max("precision").over(own.rowsBetween(0, Window.unboundedFollowing))
    return curve.join(F.broadcast(after) if at_most(after) else after, [by, "_p"]).withColumn("envelope", F.greatest(rest, "_best")).drop("_p", "_best")


def average_precision(curve: DataFrame, by: str = "class") -> DataFrame:
    """ap (area under the envelope) and ap11 (mean of the best precision at recalls 0, 0.1 .. 1).

    Recall grows by 1 / npos at each true positive and nowhere else, so the area is a plain sum."""
    area = F.sum(F.when(F.col("tp"), F.try_divide("envelope", "npos")).otherwise(0.0))
    at = [F.coalesce(F.max(F.when(F.col("recall") >= F.lit(k / 10), F.col("precision"))), F.lit(0.0)) for k in range(11)]
    total = at[0]
    for x in at[1:]:
        total = total + x
    return curve.groupBy(by).agg(area.alias("ap"), (total / 11).alias("ap11"))


def iou_matrix(a: np.ndarray, b: np.ndarray, crowd: np.ndarray | None = None) -> np.ndarray:
    """IoU of boxes (x0, y0, x1, y1); with a crowd column of b, over a's area only."""
    w = np.clip(np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0, None)
    h = np.clip(np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0, None)
    inter = w * h
    size_a, size_b = (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1]), (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    union = size_a[:, None] + size_b[None, :] - inter
    if crowd is not None:
        union = np.where(crowd[None, :], size_a[:, None], union)
    return np.divide(inter, union, out=np.zeros_like(inter, dtype=float), where=union > 0)


def greedy_matches(scores: np.ndarray, ious: np.ndarray, ignore: np.ndarray, threshold: float, crowd: np.ndarray | None = None) -> np.ndarray:
    """Ground truth of each detection or -1: by falling score the best one not taken, real ones before ignored ones. Crowds (all that are
    ignored, if not given) are never taken."""
    taken, crowd = np.zeros(ious.shape[1], bool), ignore if crowd is None else crowd
    out = np.full(len(scores), -1)
    for d in np.argsort(-scores, kind="stable"):
        for kind in (False, True):
            able = (ious[d] >= threshold) & (ignore == kind) & (~taken | crowd)
            if able.any():
                g = int(np.where(able, ious[d], -1).argmax())
                out[d] = g
                taken[g] = True
                break
    return out


BOX, ROTATED = ["x0", "y0", "x1", "y1"], ["cx", "cy", "w", "h", "angle"]
#: Areas of small, medium and large objects.
SIZES = {"s": (0.0, 32.0**2), "m": (32.0**2, 96.0**2), "l": (96.0**2, 1e10)}


def _area(rotated: bool) -> Column:
    return (F.col("w") * F.col("h") if rotated else Box.of().area).cast("double")


def coco_truths(gt: DataFrame, area: tuple[float, float] | None = None, rotated: bool = False) -> DataFrame:
    """gt with crowd and ignore: crowds and, with area, objects outside it count neither way."""
    crowd = F.coalesce(F.col("crowd"), F.lit(False)) if "crowd" in gt.columns else F.lit(False)
    size = F.col("area") if "area" in gt.columns else _area(rotated)
    outside = F.lit(False) if area is None else (size < area[0]) | (size > area[1])
    return gt.withColumn("crowd", crowd).withColumn("ignore", F.col("crowd") | outside)


def coco_matches(gt: DataFrame, det: DataFrame, max_dets: int = 100, steps: tuple[float, ...] = IOU_STEPS, area: tuple[float, float] | None = None, rotated: bool = False, per_class: bool = True) -> DataFrame:
    """class, score, det, iou_step, tp of every detection that counts: matched greedily within an image and class. An image's rows fit
    one task by nature: it keeps max_dets detections, of each class or of all. Boxes are x0 .. y1 or, rotated, cx, cy, w, h, angle; with
    area, detections outside it that match nothing don't count."""
    cols = ROTATED if rotated else BOX
    top = det.withColumn("_k", F.row_number().over(Window.partitionBy(*["image", "class"][: 1 + per_class]).orderBy(F.desc("score"), "id"))).where(F.col("_k") <= max_dets)
    boxes = [F.col(c).cast("double").alias(c) for c in cols]
    left = coco_truths(gt, area, rotated).select("image", "class", "id", F.lit(0.0).alias("score"), "crowd", "ignore", F.lit(True).alias("is_gt"), *boxes)
    size = _area(rotated)
    outside = F.lit(False) if area is None else (size < area[0]) | (size > area[1])
    right = top.select("image", "class", "id", F.col("score").cast("double").alias("score"), F.lit(False).alias("crowd"), outside.alias("ignore"), F.lit(False).alias("is_gt"), *boxes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        from tesserae.operators.matching import rotated_iou

        g, d = pdf[pdf["is_gt"]].sort_values("id"), pdf[~pdf["is_gt"]].sort_values(["score", "id"], ascending=[False, True])
        out = []
        crowd, ignore, far = g["crowd"].to_numpy(bool), g["ignore"].to_numpy(bool), d["ignore"].to_numpy(bool)
        ious = rotated_iou(d[cols].to_numpy(), g[cols].to_numpy()) if rotated else iou_matrix(d[cols].to_numpy(), g[cols].to_numpy(), crowd)
        for t in steps:
            m = greedy_matches(d["score"].to_numpy(), ious, ignore, t, crowd)
            ignored = np.array([ignore[k] if k >= 0 else out_ for k, out_ in zip(m, far, strict=True)], bool)
            part = pd.DataFrame({"class": key[1], "image": key[0], "det": d["id"].to_numpy(), "score": d["score"].to_numpy(), "iou_step": t, "tp": m >= 0})
            out.append(part[~ignored])
        return pd.concat(out)

    ready(gt.sparkSession)
    kinds = dict(gt.dtypes)
    return left.unionByName(right).groupBy("image", "class").applyInPandas(run, f"class {kinds['class']}, image {kinds['image']}, det {dict(det.dtypes)['id']}, score double, iou_step double, tp boolean")


def coco_ap(matches: DataFrame, gt: DataFrame, area: tuple[float, float] | None = None, rotated: bool = False) -> DataFrame:
    """class, iou_step, ap: mean over 101 recalls of the envelope at the first detection that reaches the recall."""
    positives = coco_truths(gt, area, rotated).where(~F.col("ignore")).groupBy("class").agg(F.count("*").alias("npos"))
    rows = matches.withColumn("key", F.struct("class", "iou_step"))
    steps = matches.select("class", "iou_step").distinct().join(positives, "class").select(F.struct("class", "iou_step").alias("key"), "npos")
    curve = precision_recall(rows, steps, "key")
    at = [F.coalesce(F.max(F.when(F.col("recall") >= F.lit(r) - 1e-12, F.col("envelope"))), F.lit(0.0)) for r in RECALL_STEPS]
    mean = F.aggregate(F.array(*at), F.lit(0.0), lambda a, x: a + x) / len(at)
    return curve.groupBy("key").agg(mean.alias("ap")).select("key.class", "key.iou_step", "ap")


def _mean_ap(ap: DataFrame, gt: DataFrame, area: tuple[float, float] | None, rotated: bool, steps: tuple[float, ...]) -> DataFrame:
    """class, iou_step, ap of every class with a positive, 0 where nothing was detected."""
    held = coco_truths(gt, area, rotated).where(~F.col("ignore")).select("class").distinct()
    grid = held.withColumn("iou_step", F.explode(F.array(*[F.lit(t) for t in steps])))
    return grid.join(ap, ["class", "iou_step"], "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))


def coco_report(gt: DataFrame, det: DataFrame, max_dets: int = 100, rotated: bool = False, names: DataFrame | None = None) -> DataFrame:
    """metric, value: AP, AP50, AP75, by size APs, APm, APl, and AP-<class> of each class (its name, if names has class and name); in
    per cent, NaN where no class has a positive."""
    shares = []
    for metric, area in {"": None, **SIZES}.items():
        own = written(_mean_ap(coco_ap(coco_matches(gt, det, max_dets, area=area, rotated=rotated), gt, area, rotated), gt, area, rotated, IOU_STEPS), "ap")
        one = lambda where, name: own.where(where).agg((100 * F.avg("ap")).alias("value")).select(F.lit(name).alias("metric"), F.coalesce("value", F.lit(float("nan"))).alias("value"))  # noqa: B023, E731
        shares.append(one("true", f"AP{metric}"))
        if area is None:
            shares += [one("abs(iou_step - 0.5) < 1e-9", "AP50"), one("abs(iou_step - 0.75) < 1e-9", "AP75")]
            each = own.groupBy("class").agg((100 * F.avg("ap")).alias("value"))
            label = F.col("class").cast("string")
            if names is not None:
                each, label = each.join(names.select("class", "name"), "class", "left"), F.coalesce("name", F.col("class").cast("string"))
            shares.append(each.select(F.concat(F.lit("AP-"), label).alias("metric"), "value"))
    return reduce(DataFrame.unionByName, shares)


def lvis_report(gt: DataFrame, det: DataFrame, negative: DataFrame, not_exhaustive: DataFrame, images: DataFrame, max_dets: int = 300) -> DataFrame:
    """metric, value: AP, AP50, AP75 and of rare, common and frequent classes APr, APc, APf, in per cent.

    A class counts in an image only if it is there or known not to be (negative: image, class); where its annotation isn't exhaustive
    (not_exhaustive: image, class) a detection without a match counts neither way. images: class and the number of images it is in."""
    known = gt.select("image", "class").unionAll(negative.select("image", "class")).distinct()
    judged = det.join(known, ["image", "class"], "left_semi")
    matches = coco_matches(gt, judged, max_dets, per_class=False)
    loose = not_exhaustive.select("image", "class").distinct().withColumn("_loose", F.lit(True))
    matches = written(matches.join(loose, ["image", "class"], "left").where(F.col("tp") | F.col("_loose").isNull()).drop("_loose"), "matches")
    ap = written(_mean_ap(coco_ap(matches, gt), gt, None, False, IOU_STEPS).join(frequency_groups(images).select("class", "group"), "class", "left"), "ap")
    one = lambda where, name: ap.where(where).agg((100 * F.avg("ap")).alias("value")).select(F.lit(name).alias("metric"), F.coalesce("value", F.lit(float("nan"))).alias("value"))
    shares = [one("true", "AP"), one("abs(iou_step - 0.5) < 1e-9", "AP50"), one("abs(iou_step - 0.75) < 1e-9", "AP75")]
    return reduce(DataFrame.unionByName, shares + [one(f"group = '{g}'", f"AP{g}") for g in "rcf"])


def proposal_recall(gt: DataFrame, proposals: DataFrame, limit: int, area: tuple[float, float] = (0, 1e10), steps: tuple[float, ...] = IOU_STEPS) -> DataFrame:
    """ar, num_pos: greedy one-to-one matches by the globally best pair, image by image; images without either side don't count."""
    top = proposals.withColumn("_k", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("score"), "id"))).where(F.col("_k") <= limit)
    from tesserae.operators.matching import greedy_one_to_one

    box = Box.of()
    cols = ["image", "x0", "y0", "x1", "y1"]
    able = gt.where((box.area >= area[0]) & (box.area <= area[1])).select(F.col("id") if "id" in gt.columns else F.monotonically_increasing_id().alias("id"), *cols)
    won = greedy_one_to_one(top.select("id", *cols), able).agg(*[F.count_if(F.col("iou") >= t).alias(f"r{int(t * 100)}") for t in steps])
    positives = able.join(small(top.select("image").distinct()), "image", "left_semi").agg(F.count("*").alias("num_pos"))
    recall = [F.try_divide(F.col(f"r{int(t * 100)}") if t > 0 else F.col("num_pos"), "num_pos") for t in steps]
    return positives.crossJoin(F.broadcast(won)).select((sum(recall[1:], recall[0]) / len(steps)).alias("ar"), "num_pos")


def panoptic_quality(pixels: DataFrame, void: int = 0) -> DataFrame:
    """class, pq, sq, rq from pixels (image, gt, pred, gt_class, pred_class): segments match at IoU over 1/2, which makes the match
    unique; unmatched predictions that are mostly void don't count."""
    both = pixels.groupBy("image", "gt", "pred", "gt_class", "pred_class").agg(F.count("*").alias("n"))
    gts = both.where(F.col("gt") != void).groupBy("image", "gt", "gt_class").agg(F.sum("n").alias("gt_area"))
    preds = both.where(F.col("pred") != void).groupBy("image", "pred", "pred_class").agg(F.sum("n").alias("pred_area"), F.sum(F.when(F.col("gt") == void, F.col("n")).otherwise(0)).alias("void_area"))
    pairs = both.where((F.col("gt") != void) & (F.col("pred") != void) & (F.col("gt_class") == F.col("pred_class"))).join(gts, ["image", "gt", "gt_class"]).join(preds, ["image", "pred", "pred_class"])
    matched = pairs.withColumn("iou", F.col("n") / (F.col("gt_area") + F.col("pred_area") - F.col("n") - F.col("void_area"))).where("iou > 0.5")
    tp = matched.groupBy(F.col("gt_class").alias("class")).agg(F.count("*").alias("tp"), F.sum("iou").alias("iou"))
    fn = gts.join(matched.select("image", "gt"), ["image", "gt"], "left_anti").groupBy(F.col("gt_class").alias("class")).agg(F.count("*").alias("fn"))
    fp = preds.join(matched.select("image", "pred"), ["image", "pred"], "left_anti").where("void_area <= 0.5 * pred_area").groupBy(F.col("pred_class").alias("class")).agg(F.count("*").alias("fp"))
    rows = tp.join(fn, "class", "full").join(fp, "class", "full").na.fill(0)
    rq = F.try_divide("tp", F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn"))
    sq = F.coalesce(F.try_divide("iou", "tp"), F.lit(0.0))
    return rows.select("class", (sq * rq).alias("pq"), sq.alias("sq"), rq.alias("rq"))


def check_expected(results: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (task, metric, value, tolerance) with ok: what is missing or not finite fails."""
    from tesserae.functions.scalar import within

    out = expected.join(results.select("task", "metric", F.col("value").alias("actual")), ["task", "metric"], "left")
    return out.withColumn("ok", within(F.col("actual"), F.col("value"), F.col("tolerance")))


def frequency_groups(images_per_class: DataFrame, n: str = "images") -> DataFrame:
    """group r, c or f: up to 10 images, up to 100, more."""
    return images_per_class.withColumn("group", F.when(F.col(n) <= 10, "r").when(F.col(n) <= 100, "c").otherwise("f"))


def accuracy(rows: DataFrame, gt: Column, pred: Column, background: int) -> DataFrame:
    """Accuracy of all, of foreground, and the share of foreground predicted as background."""
    fg = (gt >= 0) & (gt < background)
    share = lambda a, b: F.try_divide(F.count_if(a).cast("double"), F.count_if(b).cast("double"))
    return rows.agg(share(gt == pred, F.lit(True)).alias("cls_accuracy"), share(fg & (gt == pred), fg).alias("fg_cls_accuracy"), share(fg & (pred == background), fg).alias("false_negative"))


class Evaluator:
    """Evaluation in three steps: reset(), process() of any number of batches of rows, evaluate() once over all of them.

    measure takes all rows that were processed and returns metric, value. Batches are written as they come, so nothing is held."""

    def __init__(self, measure: Callable[[DataFrame], DataFrame]):
        self.measure = measure
        self.reset()

    def reset(self) -> None:
        self.batches: list[DataFrame] = []

    def process(self, rows: DataFrame) -> None:
        self.batches.append(written(rows, "batch"))

    def evaluate(self) -> DataFrame:
        if not self.batches:
            raise ValueError("nothing was processed")
        return self.measure(reduce(DataFrame.unionByName, self.batches))


class Evaluators(Evaluator):
    """Several as one; a metric that two of them give is an error."""

    def __init__(self, evaluators: dict[str, Evaluator]):
        self.evaluators = evaluators

    def reset(self) -> None:
        for e in self.evaluators.values():
            e.reset()

    def process(self, rows: DataFrame) -> None:
        for e in self.evaluators.values():
            e.process(rows)

    def evaluate(self) -> DataFrame:
        found = written(reduce(DataFrame.unionByName, [e.evaluate().select(F.lit(name).alias("task"), "metric", "value") for name, e in self.evaluators.items()]), "metrics")
        twice = found.groupBy("metric").agg(F.count_distinct("task").alias("n")).where("n > 1").first()
        if twice:
            raise ValueError(f"{twice['metric']} is given more than once")
        return found
