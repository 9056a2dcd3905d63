"""Cell regions from nuclei: four ways to grow, pixel tables in and out (y, x, label)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tesserae.operators import raster
from tesserae.session import ready

MODES = ("nuclear", "fixed", "voronoi", "watershed")


def seeds(nuclei: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """One pixel a cell: its rounded centroid (label, centroid_y, centroid_x); where two cells share one, the smaller label has it and the
    other takes its first pixel in reading order. A cell without a centroid takes its middle pixel."""
    own = nuclei.where("label > 0").select("label", "y", "x")
    by_place = Window.partitionBy("label").orderBy("y", "x")
    first = own.groupBy("label").agg(F.min(F.struct("y", "x")).alias("p")).select("label", "p.y", "p.x")
    ranked = own.withColumn("_k", F.row_number().over(by_place) - 1).join(own.groupBy("label").agg(F.floor(F.count("*") / 2).alias("_m")), "label")
    middle = ranked.where("_k = _m").select("label", "y", "x")
    if centroids is None:
        return middle
    at = centroids.select("label", F.rint("centroid_y").cast("int").alias("y"), F.rint("centroid_x").cast("int").alias("x"))
    turn = at.withColumn("_k", F.row_number().over(Window.partitionBy("y", "x").orderBy("label")))
    given = turn.where("_k = 1").drop("_k").unionByName(turn.where("_k > 1").select("label").join(first, "label"))
    return given.unionByName(middle.join(centroids.select("label"), "label", "left_anti"))


def grow(nuclei: DataFrame, mode: str, distance: float = 0, centroids: DataFrame | None = None, membrane: DataFrame | None = None, sigma: float = 0.0, chunk: int = 512) -> DataFrame:
    """y, x, label of the cells' regions.

    nuclear: the nuclei as they are. fixed: pixels within distance of a nucleus. voronoi: pixels within distance of a cell's seed go to the
    nearest one, nuclei stay. watershed: within distance of the nuclei, regions flood the edges of the membrane channel (y, x, value),
    chunk by chunk with as much around it as it can depend on."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    own = nuclei.where("label > 0").select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("label").cast("long").alias("label"))
    if mode == "nuclear":
        return own
    if mode == "fixed":
        return raster.expand_labels(own, distance).select("y", "x", "label")
    if mode == "voronoi":
        near = raster.expand_labels(seeds(own, centroids), distance).select("y", "x", F.col("label").alias("_near"))
        both = near.join(own, ["y", "x"], "full")
        return both.select("y", "x", F.coalesce("label", "_near").alias("label"))
    if membrane is None:
        raise ValueError("watershed needs a membrane channel")
    return _flooded(own, membrane, distance, sigma, chunk)


def halo(distance: float, sigma: float) -> int:
    """Pixels around a chunk that its flooding can depend on."""
    return math.ceil(distance) + (math.ceil(3 * sigma) + 2 if sigma > 0 else 2)


def flood(labels: np.ndarray, image: np.ndarray, distance: float, sigma: float) -> np.ndarray:
    """The watershed kernel: intensities between their 1st and 99th percentile, smoothed; edges are the elevation."""
    if not labels.any():
        return labels.copy()
    allowed = raster.nearest(labels, distance)[0] > 0
    finite = np.isfinite(image)
    low, high = np.percentile(image[finite], [1.0, 99.0]) if finite.any() else (0.0, 0.0)
    scaled = np.clip((np.where(finite, image, low) - low) / (high - low), 0, 1) if high > low else np.zeros_like(image)
    smooth = raster.gaussian(scaled, sigma) if sigma > 0 else scaled
    return raster.watershed(raster.sobel(smooth), labels, allowed | (labels > 0))


def _flooded(nuclei: DataFrame, membrane: DataFrame, distance: float, sigma: float, chunk: int) -> DataFrame:
    reach = halo(distance, sigma)
    pixels = membrane.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("value")).join(nuclei, ["y", "x"], "full")
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / chunk), F.floor((F.col(c) + reach) / chunk)))
    dealt = pixels.withColumn("_cy", span("y")).withColumn("_cx", span("x"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
        ys, xs = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0
        labels, image = np.zeros((ys.max() + 1, xs.max() + 1), np.int64), np.full((ys.max() + 1, xs.max() + 1), np.nan)
        labels[ys, xs], image[ys, xs] = pdf["label"].fillna(0).to_numpy(np.int64), pdf["value"].to_numpy()
        out = flood(labels, image, distance, sigma)
        y, x = np.nonzero(out)
        found = pd.DataFrame({"y": y + y0, "x": x + x0, "label": out[y, x]})
        return found[(found["y"] // chunk == key[0]) & (found["x"] // chunk == key[1])].astype({"y": "int32", "x": "int32"})

    ready(nuclei.sparkSession)
    return dealt.groupBy("_cy", "_cx").applyInPandas(run, "y int, x int, label long")
