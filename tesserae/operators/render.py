"""Rendering and geometric transforms as column work: contrast limits, composites, overlays, pasted masks, moved coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tesserae.functions.geometry import Box
from tesserae.functions.scalar import finite, round_half_up, tone


def auto_contrast(pixels: DataFrame, by: str = "channel", value: str = "value", low: float = 0.01, high: float = 0.998) -> DataFrame:
    """low and high percentiles of finite values; the ends where they coincide."""
    v = F.when(finite(F.col(value).cast("double")), F.col(value).cast("double"))
    out = pixels.groupBy(by).agg(F.percentile(v, F.array(F.lit(low), F.lit(high))).alias("_p"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    spread = F.col("_p")[1] > F.col("_p")[0]
    return out.select(by, F.when(spread, F.col("_p")[0]).otherwise(F.col("_lo")).alias("low"), F.when(spread, F.col("_p")[1]).otherwise(F.col("_hi")).alias("high"))


def composite(pixels: DataFrame, channels: dict[int, tuple[float, float, tuple[float, float, float]]], gamma: float = 1.0, opacity: float = 1.0) -> DataFrame:
    """y, x, red, green, blue (0..255): tones of the given channels (low, high, colour) added up and clipped."""
    rows = None
    for c, (lo, hi, colour) in channels.items():
        t = tone(F.col("value").cast("double"), lo, hi, gamma, opacity)
        part = pixels.where(F.col("channel") == c).select("y", "x", *[(t * w).alias(n) for n, w in zip(("r", "g", "b"), colour, strict=True)])
        rows = part if rows is None else rows.unionAll(part)
    byte = lambda n: round_half_up(F.least(F.lit(1.0), F.sum(n)) * 255).cast("int")
    return rows.groupBy("y", "x").agg(byte("r").alias("red"), byte("g").alias("green"), byte("b").alias("blue"))


def overlay(runs: DataFrame, x0: int, y0: int, x1: int, y1: int, step: int = 1) -> DataFrame:
    """y, x (of a view reduced by step) and the smallest id that covers it."""
    seen = runs.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x0") < x1) & (F.col("x1") > x0))
    lo, hi = F.greatest("x0", F.lit(x0)), F.least("x1", F.lit(x1)) - 1
    cells = seen.select("id", F.floor((F.col("y") - y0) / step).alias("y"), F.explode(F.sequence(F.floor((lo - x0) / step), F.floor((hi - x0) / step))).alias("x"))
    return cells.groupBy("y", "x").agg(F.min("id").alias("id"))


def paste(masks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """id, y, x of soft masks (id, size, values: row by row) stretched over their boxes, bilinear, over the threshold."""
    b = Box.of()
    ys, xs = F.sequence(F.floor(b.y0).cast("int"), (F.ceil(b.y1) - 1).cast("int")), F.sequence(F.floor(b.x0).cast("int"), (F.ceil(b.x1) - 1).cast("int"))
    rows = masks.select("*", F.explode(ys).alias("y")).select("*", F.explode(xs).alias("x"))
    u = (F.col("x") + 0.5 - b.x0) / b.width * F.col("size") - 0.5
    v = (F.col("y") + 0.5 - b.y0) / b.height * F.col("size") - 0.5
    rows = rows.withColumn("_u", u).withColumn("_v", v)
    i, j = F.floor("_v").cast("int"), F.floor("_u").cast("int")
    fy, fx = F.col("_v") - i, F.col("_u") - j
    inside = lambda a, c: (a >= 0) & (c >= 0) & (a < F.col("size")) & (c < F.col("size"))
    at = lambda a, c: F.when(inside(a, c), F.get("values", a * F.col("size") + c)).otherwise(0.0)
    value = at(i, j) * (1 - fy) * (1 - fx) + at(i, j + 1) * (1 - fy) * fx + at(i + 1, j) * fy * (1 - fx) + at(i + 1, j + 1) * fy * fx
    return rows.withColumn("_p", value).where(F.col("_p") >= threshold).select("id", "y", "x")


def flip(box: Box, width) -> Box:
    return Box(width - box.x1, box.y0, width - box.x0, box.y1)


def resize(box: Box, old: tuple[float, float], new: tuple[float, float]) -> Box:
    """old, new: width and height."""
    return box.scale(new[0] / old[0], new[1] / old[1])


def crop(box: Box, x: float, y: float, width: float, height: float) -> Box:
    return box.shift(-x, -y).clip(width, height)


def rotate(x: Column, y: Column, degrees: float, width: float, height: float) -> tuple[Column, Column]:
    """A point after the image turns about its centre, counter-clockwise, its frame growing to hold it."""
    t = math.radians(degrees)
    c, s = math.cos(t), math.sin(t)
    w, h = width * abs(c) + height * abs(s), width * abs(s) + height * abs(c)
    dx, dy = x - width / 2, y - height / 2
    return dx * c + dy * s + w / 2, -dx * s + dy * c + h / 2


def best_level(levels: DataFrame, wanted: float) -> DataFrame:
    """The level whose scale is nearest by ratio, the first on ties."""
    return levels.orderBy(F.abs(F.ln(F.lit(wanted) / F.col("scale"))), "level").limit(1)
