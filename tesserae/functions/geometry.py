"""Box and rectangle algebra as Column expressions. Boxes are (x0, y0, x1, y1) with x1, y1 beyond the box."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Box:
    """Four columns that make a box."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(prefix: str = "", suffix: str = "") -> Box:
        return Box(*[F.col(f"{prefix}{n}{suffix}") for n in ("x0", "y0", "x1", "y1")])

    @staticmethod
    def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
        return Box(x, y, x + w, y + h)

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    def xywh(self) -> tuple[Column, ...]:
        return self.x0, self.y0, self.width, self.height

    def clip(self, width, height) -> Box:
        lim = lambda v, m: F.least(F.greatest(v, F.lit(0)), m if isinstance(m, Column) else F.lit(m))
        return Box(lim(self.x0, width), lim(self.y0, height), lim(self.x1, width), lim(self.y1, height))

    def scale(self, sx: float, sy: float) -> Box:
        return Box(self.x0 * sx, self.y0 * sy, self.x1 * sx, self.y1 * sy)

    def shift(self, dx, dy) -> Box:
        return Box(self.x0 + dx, self.y0 + dy, self.x1 + dx, self.y1 + dy)

    def intersect(self, other: Box) -> Box:
        return Box(F.greatest(self.x0, other.x0), F.greatest(self.y0, other.y0), F.least(self.x1, other.x1), F.least(self.y1, other.y1))

    def contains_point(self, x: Column, y: Column) -> Column:
        """Half-open."""
        return (x >= self.x0) & (x < self.x1) & (y >= self.y0) & (y < self.y1)

    def contains(self, other: Box) -> Column:
        return (other.x0 >= self.x0) & (other.y0 >= self.y0) & (other.x1 <= self.x1) & (other.y1 <= self.y1)

    def overlaps(self, other: Box) -> Column:
        """Strict: boxes that only touch don't overlap."""
        return (self.x0 < other.x1) & (self.x1 > other.x0) & (self.y0 < other.y1) & (self.y1 > other.y0)

    def meets(self, other: Box) -> Column:
        """Inclusive: as viewers ask."""
        return (self.x0 <= other.x1) & (self.x1 >= other.x0) & (self.y0 <= other.y1) & (self.y1 >= other.y0)

    def nonempty(self, threshold: float = 0.0) -> Column:
        return (self.width > threshold) & (self.height > threshold)

    def inside_image(self, width, height, border: float = 0) -> Column:
        return (self.x0 >= -border) & (self.y0 >= -border) & (self.x1 < width + border) & (self.y1 < height + border)


def intersection(a: Box, b: Box, pad: float = 0) -> Column:
    """Common area; pad 1 counts pixel-inclusive widths."""
    zero = F.lit(0)
    i = a.intersect(b)
    return F.greatest(zero, i.width + pad) * F.greatest(zero, i.height + pad)


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    return F.when(inter > 0, inter / (a.area + b.area - inter)).otherwise(0.0)


def ioa(a: Box, b: Box) -> Column:
    """Common area over b's area."""
    inter = intersection(a, b)
    return F.when(inter > 0, inter / b.area).otherwise(0.0)


def containment(inter: Column, area_a: Column, area_b: Column) -> Column:
    smaller = F.least(area_a, area_b)
    return F.when(smaller > 0, inter / smaller).otherwise(0.0)


def point_box_distances(x: Column, y: Column, b: Box) -> tuple[Column, ...]:
    """To the left, top, right and bottom side."""
    return x - b.x0, y - b.y0, b.x1 - x, b.y1 - y


def normalize_angle(a: Column) -> Column:
    """Degrees within [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def rotated_extent(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Box:
    """The upright box around a rotated one."""
    t = F.radians(degrees)
    c, s = F.abs(F.cos(t)), F.abs(F.sin(t))
    dx, dy = (c * w + s * h) / 2, (s * w + c * h) / 2
    return Box(cx - dx, cy - dy, cx + dx, cy + dy)


def fpn_level(area: Column, lowest: int, highest: int, size: float = 224.0, level: int = 4) -> Column:
    raw = F.floor(level + F.log2(F.sqrt(area) / size + 1e-8))
    return F.least(F.greatest(raw, F.lit(lowest)), F.lit(highest)).cast("int")


SCALE_CLAMP = math.log(1000.0 / 16)


def encode_deltas(source: Box, target: Box, weights: tuple[float, ...] = (10.0, 10.0, 5.0, 5.0)) -> tuple[Column, ...]:
    wx, wy, ww, wh = weights
    (sx, sy), (tx, ty) = source.center, target.center
    return wx * (tx - sx) / source.width, wy * (ty - sy) / source.height, ww * F.ln(target.width / source.width), wh * F.ln(target.height / source.height)


def decode_deltas(box: Box, dx: Column, dy: Column, dw: Column, dh: Column, weights: tuple[float, ...] = (10.0, 10.0, 5.0, 5.0)) -> Box:
    wx, wy, ww, wh = weights
    cx, cy = box.center
    x, y = dx / wx * box.width + cx, dy / wy * box.height + cy
    w = F.exp(F.least(dw / ww, F.lit(SCALE_CLAMP))) * box.width
    h = F.exp(F.least(dh / wh, F.lit(SCALE_CLAMP))) * box.height
    return Box(x - w / 2, y - h / 2, x + w / 2, y + h / 2)


def diou_loss(a: Box, b: Box, eps: float = 1e-7) -> Column:
    """One minus IoU plus the centres' squared distance over the squared diagonal around both."""
    inter = intersection(a, b)
    iou_ = inter / (a.area + b.area - inter + eps)
    (ax, ay), (bx, by) = a.center, b.center
    ow, oh = F.greatest(a.x1, b.x1) - F.least(a.x0, b.x0), F.greatest(a.y1, b.y1) - F.least(a.y0, b.y0)
    return 1 - iou_ + (F.pow(ax - bx, 2) + F.pow(ay - by, 2)) / (ow * ow + oh * oh + eps)


def ciou_loss(a: Box, b: Box, eps: float = 1e-7) -> Column:
    inter = intersection(a, b)
    iou_ = inter / (a.area + b.area - inter + eps)
    v = (4 / math.pi**2) * F.pow(F.atan(b.width / b.height) - F.atan(a.width / a.height), 2)
    return diou_loss(a, b, eps) + v * v / (1 - iou_ + v + eps)


def shoelace(xs: Column, ys: Column) -> Column:
    """Area of a polygon from arrays of its corners."""
    n = F.size(xs)
    terms = F.transform(xs, lambda x, i: x * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i))
    return 0.5 * F.abs(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v))


def anchors(sizes: tuple[float, ...], ratios: tuple[float, ...]) -> list[tuple[float, float, float, float]]:
    """Corner boxes around the origin: each size's area at each height to width ratio."""
    out = []
    for s in sizes:
        for r in ratios:
            w = math.sqrt(s * s / r)
            out.append((-w / 2, -w * r / 2, w / 2, w * r / 2))
    return out


def keypoint_to_heatmap(x: Column, y: Column, roi: Box, size: int) -> tuple[Column, Column, Column]:
    """Heatmap cell of a keypoint in a region, and whether it lies in it; the far edge falls in the last cell."""
    cell = lambda v, lo, hi: F.when(v == hi, size - 1).otherwise(F.floor((v - lo) * size / (hi - lo))).cast("long")
    cx, cy = cell(x, roi.x0, roi.x1), cell(y, roi.y0, roi.y1)
    return cx, cy, (cx >= 0) & (cy >= 0) & (cx < size) & (cy < size)
