"""Duplicate reconciliation: links, groups, representatives, global numbers, merged masks and label images."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tesserae.functions.geometry import Box, intersection
from tesserae.operators import cells, masks
from tesserae.operators.components import connected_components
from tesserae.operators.sampling import numbered, representative
from tesserae.session import dealt, small


@dataclass(frozen=True)
class ReconcileOptions:
    """A link needs IoU >= iou or containment >= containment; an IoU threshold of 0 links all boxes that overlap."""

    iou: float = 0.3
    containment: float = 0.65
    match_classes: bool = True
    strategy: str = "representative"
    bucket: float = 512

    def __post_init__(self):
        if not (0 <= self.iou <= 1 and 0 <= self.containment <= 1) or self.iou == self.containment == 0:
            raise ValueError("thresholds must be within 0..1 and not both 0")
        if self.strategy not in ("representative", "union"):
            raise ValueError("strategy must be representative or union")


def links(predictions: DataFrame, options: ReconcileOptions, runs: DataFrame | None = None, places: int | None = None) -> DataFrame:
    """a, b, intersection, iou, containment of duplicates in different tiles, by masks (runs) or, without these, by boxes.

    Boxes and areas bound the ratios from above, so most pairs are settled before any mask is read. places: boxes' ratios are rounded to,
    while pairs are made."""
    same = ("class_id",) if options.match_classes else ()
    kind = predictions.select(intersection(Box.of(), Box.of()).alias("i")).dtypes[0][1]
    if runs is None:
        return cells.links(predictions, options.bucket, same, options.iou, options.containment, True, kind, places)
    held = predictions.join(dealt(masks.lists(runs)), "id")
    measured = cells.links(held, options.bucket, same, options.iou, options.containment, False, "bigint", by_masks=True)
    return measured.where((F.col("iou") >= options.iou) | (F.col("containment") >= options.containment))


def overlaps(predictions: DataFrame, options: ReconcileOptions, places: int | None = None) -> DataFrame:
    """links() by boxes with intersection, iou and containment of the masks: predictions have a column mask, as masks.lists() makes it."""
    same = ("class_id",) if options.match_classes else ()
    return cells.links(predictions, options.bucket, same, options.iou, options.containment, True, "bigint", places, by_masks=True)


def ties(predictions: DataFrame, options: ReconcileOptions) -> DataFrame:
    """a, b: fewer links by boxes with the same groups. Their number grows with the predictions, not with all that overlap."""
    return cells.ties(predictions, options.bucket, ("class_id",) if options.match_classes else (), options.iou, options.containment)


def groups(predictions: DataFrame, found: DataFrame) -> DataFrame:
    """predictions with root: the smallest id of its group."""
    tied = connected_components(found, "a", "b")
    return predictions.join(dealt(tied.select(F.col("node").alias("id"), F.col("component").alias("root"))), "id", "left").withColumn("root", F.coalesce("root", "id"))


def global_cells(grouped: DataFrame) -> DataFrame:
    """One row a group: representative, its place and class, counts, and global_cell_id from 1 by (y, x, class, first member)."""
    best = representative(grouped, "root")
    own = grouped.select(F.col("id").alias("representative"), "class_id", "score", "area", "centroid_x", "centroid_y")
    return numbered(best.join(dealt(own), "representative"), ["centroid_y", "centroid_x", "class_id", "first_member"], "global_cell_id")


def cell_sources(grouped: DataFrame, cells: DataFrame) -> DataFrame:
    """global_cell_id, prediction_id, is_representative. One group may hold most predictions, so few cells travel to them."""
    rows = grouped.select("id", "root").join(small(cells.select("root", "global_cell_id", "representative")), "root")
    return rows.select("global_cell_id", F.col("id").alias("prediction_id"), (F.col("id") == F.col("representative")).alias("is_representative"))


def cell_masks(runs: DataFrame, sources: DataFrame, strategy: str) -> DataFrame:
    """Runs by global_cell_id: the representative's, or the union of all sources'."""
    if strategy == "representative":
        return runs.join(sources.where("is_representative").select(F.col("prediction_id").alias("id"), "global_cell_id"), "id").select(F.col("global_cell_id").alias("id"), "y", "x0", "x1")
    return masks.union(runs, sources.select(F.col("prediction_id").alias("id"), F.col("global_cell_id").alias("group")))


def label_image(cell_runs: DataFrame, cells: DataFrame) -> DataFrame:
    """y, x, label: where cells overlap the higher score, then the smaller number, has the pixel."""
    return masks.paint(cell_runs, cells.select(F.col("global_cell_id").alias("id"), "score"))
