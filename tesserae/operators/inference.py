"""The boundary to models: an adapter turns tiles into predictions, and what follows is relational."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tesserae.operators.masks import pack
from tesserae.operators.raster import threshold_segment
from tesserae.session import ready

PREDICTIONS = "tile string, local_index int, class_id int, score double, x0 long, y0 long, x1 long, y1 long, area long, centroid_x double, centroid_y double, owned boolean, at_edge boolean, width int, height int, data binary"


@dataclass
class Found:
    """What a model sees in one image: masks over the whole image, scores and classes."""

    masks: list[np.ndarray] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    classes: list[int] = field(default_factory=list)


class Adapter(Protocol):
    """A model behind a factory: made once in each worker's task, then asked for batches of images, one answer for each."""

    def infer(self, images: list[np.ndarray]) -> list[Found]: ...


@dataclass
class ThresholdAdapter:
    """Objects over a threshold by the raster kernel; the score is the mean intensity over 255."""

    threshold: float
    options: dict = field(default_factory=dict)

    def infer(self, images: list[np.ndarray]) -> list[Found]:
        out = []
        for image in images:
            labels = threshold_segment(image, self.threshold, **self.options)
            own = [labels == k for k in range(1, int(labels.max()) + 1)]
            out.append(Found(own, [float(min(1.0, max(0.0, image[m].mean() / 255))) for m in own], [0] * len(own)))
        return out


def predict(tiles: DataFrame, factory: Callable[[], Adapter], batch: int = 8, min_score: float = 0.0, owned_only: bool = False) -> DataFrame:
    """PREDICTIONS of tiles (tile_id, read box x0..y1, core box cx0..cy1, height, width, values row by row).

    Masks without pixels and scores below min_score go; a centroid within the tile's core makes a prediction owned."""

    def rows(t, found: Found) -> list[tuple]:
        out = []
        for k, (m, score, cls) in enumerate(zip(found.masks, found.scores, found.classes, strict=True)):
            if score < min_score or not m.any():
                continue
            ys, xs = np.nonzero(m)
            x0, y0, x1, y1 = int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1
            cx, cy = float(xs.mean()) + t.x0, float(ys.mean()) + t.y0
            owned = t.cx0 <= cx < t.cx1 and t.cy0 <= cy < t.cy1
            if owned or not owned_only:
                edge = x0 == 0 or y0 == 0 or x1 == t.width or y1 == t.height
                out.append((t.tile_id, k, cls, float(score), x0 + t.x0, y0 + t.y0, x1 + t.x0, y1 + t.y0, len(ys), cx, cy, bool(owned), bool(edge), x1 - x0, y1 - y0, pack(m[y0:y1, x0:x1])))
        return out

    names = [c.split()[0] for c in PREDICTIONS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapter = factory()
        for b in batches:
            for at in range(0, len(b), batch):
                part = list(b.iloc[at : at + batch].itertuples(index=False))
                found = adapter.infer([np.asarray(t.values, float).reshape(t.height, t.width) for t in part])
                if len(found) != len(part):
                    raise ValueError("the adapter gave not one answer for each image")
                yield pd.DataFrame([r for t, f in zip(part, found, strict=True) for r in rows(t, f)], columns=names)

    ready(tiles.sparkSession)
    return tiles.select("tile_id", "x0", "y0", "cx0", "cy0", "cx1", "cy1", "height", "width", "values").mapInPandas(run, PREDICTIONS)


def augmented(views: list[DataFrame], threshold: float, limit: int, image: str = "image") -> DataFrame:
    """Detections of several views of the same images, already in common coordinates, as one set: union, suppression, the best."""
    from tesserae.operators.instances import detections

    every = None
    for k, v in enumerate(views):
        own = v.withColumn("id", F.col("id") * len(views) + k)
        every = own if every is None else every.unionByName(own)
    return detections(every, 0.0, threshold, limit, image)
