"""Tile grids with overlapping read areas and cores that own each point once; regions of interest; halo replication."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tesserae.functions.geometry import Box


@dataclass(frozen=True)
class TileOptions:
    """Either overlap_px or overlap_ratio (of the tile, half up); the overlap is at most one pixel less than the tile."""

    tile: int
    overlap_px: int | None = 128
    overlap_ratio: float | None = None

    def __post_init__(self):
        if self.tile <= 0:
            raise ValueError("tile must be positive")
        if self.overlap_ratio is not None and not 0 <= self.overlap_ratio < 1:
            raise ValueError("overlap_ratio must be in [0, 1)")
        if self.overlap_ratio is None and not 0 <= (self.overlap_px or 0) < self.tile:
            raise ValueError("overlap_px must be in [0, tile)")

    @property
    def overlap(self) -> int:
        if self.overlap_ratio is not None:
            return min(self.tile - 1, math.floor(self.tile * self.overlap_ratio + 0.5))
        return self.overlap_px or 0

    @property
    def stride(self) -> int:
        return self.tile - self.overlap

    def signature(self, width: int, height: int, level: int = 0) -> str:
        said = {"height": height, "level": level, "overlap": self.overlap, "tile": self.tile, "width": width}
        return hashlib.sha256(json.dumps(said, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def axis(length: Column, options: TileOptions) -> Column:
    """array<struct<k, start, size, core0, core1>> along one axis: the last start is shifted back so that its tile ends with the
    image; cores meet in the middle of overlaps (integers)."""
    tile, stride = options.tile, options.stride
    n = F.when(length <= tile, 1).otherwise(1 + F.ceil((length - tile) / stride)).cast("int")
    start = lambda k: F.when(k == n - 1, F.greatest(length - tile, F.lit(0))).otherwise(k * stride)
    size = F.least(F.lit(tile), length)
    middle = lambda k: F.floor((start(k) + start(k - 1) + size) / 2)  # noqa: E731  of the overlap of tiles k - 1 and k
    one = lambda k: F.struct(
        k.alias("k"), start(k).cast("int").alias("start"), size.cast("int").alias("size"),
        F.when(k == 0, 0).otherwise(middle(k)).cast("int").alias("core0"), F.when(k == n - 1, length).otherwise(middle(k + 1)).cast("int").alias("core1"),
    )
    return F.transform(F.sequence(F.lit(0), n - 1), one)


def tile_grid(images: DataFrame, options: TileOptions) -> DataFrame:
    """Tiles of images (image_id, width, height): index, row, column, tile_id, read box (x0..y1) and core box (cx0..cy1)."""
    rows = images.withColumn("_y", F.explode(axis(F.col("height"), options))).withColumn("_x", F.explode(axis(F.col("width"), options)))
    across = F.size(axis(F.col("width"), options))
    made = rows.select("image_id", F.col("_y.k").alias("row"), F.col("_x.k").alias("column"), (F.col("_y.k") * across + F.col("_x.k")).alias("index"),
        F.col("_x.start").alias("x0"), F.col("_y.start").alias("y0"), (F.col("_x.start") + F.col("_x.size")).alias("x1"), (F.col("_y.start") + F.col("_y.size")).alias("y1"),
        F.col("_x.core0").alias("cx0"), F.col("_y.core0").alias("cy0"), F.col("_x.core1").alias("cx1"), F.col("_y.core1").alias("cy1"))
    return made.withColumn("tile_id", tile_id(F.lit(0), F.col("row"), F.col("column"), F.col("y0"), F.col("x0")))


def tile_id(level: Column, row: Column, column: Column, y: Column, x: Column) -> Column:
    return F.format_string("L%03d_R%06d_C%06d_Y%09d_X%09d", level.cast("int"), row.cast("int"), column.cast("int"), y.cast("int"), x.cast("int"))


def one_image(spark: SparkSession, width: int, height: int, image_id: str = "image") -> DataFrame:
    return spark.range(1).select(F.lit(image_id).alias("image_id"), F.lit(width).alias("width"), F.lit(height).alias("height"))


def own(points: DataFrame, width: int, height: int, options: TileOptions, x: str = "x", y: str = "y") -> DataFrame:
    """points with the row and column of the one tile whose core holds each: arithmetic on the core's edges, no join. Points outside
    the image fall to the nearest tile."""

    def place(v: Column, length: int) -> Column:
        edges = F.transform(axis(F.lit(length), options), lambda t: t["core0"])
        return (F.size(F.filter(edges, lambda e: e <= F.greatest(v, F.lit(0)))) - 1).cast("int")

    return points.withColumn("column", place(F.col(x), width)).withColumn("row", place(F.col(y), height))


def roi_grid(images: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Square regions; the last ones run over the image's edge and are padded there."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > 0 and 0 <= overlap < size")
    stride = size - overlap
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int") * stride, F.lit(stride))
    rows = images.select("*", F.posexplode(starts(F.col("height"))).alias("row", "y0")).select("*", F.posexplode(starts(F.col("width"))).alias("column", "x0"))
    return rows.select(
        "image_id", "row", "column", "x0", "y0", F.least(F.lit(size), F.col("width") - F.col("x0")).alias("width"), F.least(F.lit(size), F.col("height") - F.col("y0")).alias("height"),
        F.greatest(F.lit(0), F.col("x0") + size - F.col("width")).alias("pad_right"), F.greatest(F.lit(0), F.col("y0") + size - F.col("height")).alias("pad_bottom"),
        F.format_string("ROI_R%05d_C%05d", F.col("row"), F.col("column")).alias("roi_id"),
    )


def halo(pixels: DataFrame, chunk: int, reach: int, x: str = "x", y: str = "y") -> DataFrame:
    """pixels repeated for every chunk (chunk_x, chunk_y) that needs them: their own, and those within `reach`."""
    near = lambda v: F.sequence(F.floor((F.col(v) - reach) / chunk), F.floor((F.col(v) + reach) / chunk))
    out = pixels.withColumn("chunk_x", F.explode(near(x))).withColumn("chunk_y", F.explode(near(y)))
    return out.where((F.col("chunk_x") >= 0) & (F.col("chunk_y") >= 0)).withColumn("own", (F.floor(F.col(x) / chunk) == F.col("chunk_x")) & (F.floor(F.col(y) / chunk) == F.col("chunk_y")))


def to_global(x: Column, y: Column, tile: Box) -> tuple[Column, Column]:
    return x + tile.x0, y + tile.y0


def to_local(x: Column, y: Column, tile: Box) -> tuple[Column, Column]:
    """An error for a point outside the tile."""
    ok = tile.contains_point(x, y)
    bad = F.raise_error(F.lit("the point is outside the tile")).cast("double")
    return F.when(ok, x - tile.x0).otherwise(bad), F.when(ok, y - tile.y0).otherwise(bad)


def chunks_of(box: Box, chunk: int) -> Column:
    """array<struct<cx, cy>> of the chunks a box covers."""
    xs = F.sequence(F.floor(box.x0 / chunk), F.floor((box.x1 - 1) / chunk))
    ys = F.sequence(F.floor(box.y0 / chunk), F.floor((box.y1 - 1) / chunk))
    return F.flatten(F.transform(ys, lambda cy: F.transform(xs, lambda cx: F.struct(cx.alias("cx"), cy.alias("cy")))))
