"""Raster kernels in numpy, applied per tile with a halo, and label operations that stay relational."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tesserae.session import ready


def disk(radius: float) -> list[tuple[int, int]]:
    r = int(radius)
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= radius * radius]


def shifted(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def erode(a: np.ndarray, radius: float) -> np.ndarray:
    top = True if a.dtype == bool else np.inf
    return np.minimum.reduce([shifted(a if a.dtype == bool else a.astype(float), dy, dx, top) for dy, dx in disk(radius)])


def dilate(a: np.ndarray, radius: float) -> np.ndarray:
    low = False if a.dtype == bool else -np.inf
    return np.maximum.reduce([shifted(a if a.dtype == bool else a.astype(float), dy, dx, low) for dy, dx in disk(radius)])


def opening(a: np.ndarray, radius: float) -> np.ndarray:
    return dilate(erode(a, radius), radius)


def reconstruct(seed: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Grey reconstruction by dilation of seed under mask."""
    out = np.minimum(seed, mask)
    while True:
        new = np.minimum(np.maximum.reduce([shifted(out, dy, dx, -np.inf) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]), mask)
        if np.array_equal(new, out):
            return out
        out = new


def gaussian(a: np.ndarray, sigma: float, beyond: str = "symmetric") -> np.ndarray:
    if sigma <= 0:
        return a.astype(float)
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = a.astype(float)
    for axis in (0, 1):
        padded = np.pad(out, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode=beyond)
        out = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, padded)
    return out


def median(a: np.ndarray, radius: float) -> np.ndarray:
    """Median over a disk, edges repeated."""
    r = int(radius)
    p = np.pad(a, r, mode="edge")
    return np.median([p[r + dy : r + dy + a.shape[0], r + dx : r + dx + a.shape[1]] for dy, dx in disk(radius)], axis=0)


def laplacian(a: np.ndarray) -> np.ndarray:
    p = np.pad(a.astype(float), 1, mode="symmetric")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def sobel(a: np.ndarray) -> np.ndarray:
    p = np.pad(a.astype(float), 1, mode="symmetric")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]) / 4
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]) / 4
    return np.sqrt((gx * gx + gy * gy) / 2)


def parts(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Labels from 1 of connected parts, in reading order: runs of neighbouring rows that touch are joined."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (ys, starts), ends = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
    root = list(range(len(ys)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    reach, first = int(diagonal), np.searchsorted(ys, np.arange(mask.shape[0] + 1)).tolist()
    s, e = starts.tolist(), ends.tolist()
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if s[i] < e[j] + reach and s[j] < e[i] + reach:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if e[i] < e[j]:
                i += 1
            else:
                j += 1
    number: dict[int, int] = {}
    out = np.zeros(mask.shape, np.int64)
    for k, (y, x0, x1) in enumerate(zip(ys.tolist(), s, e, strict=True)):
        out[y, x0:x1] = number.setdefault(find(k), len(number) + 1)
    return out


def components4(mask: np.ndarray) -> np.ndarray:
    return parts(mask)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    outside = components4(np.pad(~mask, 1, constant_values=True))
    return (outside != outside[0, 0])[1:-1, 1:-1] | mask


def nearest(labels: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest label within reach and its squared distance, ties to the smaller label."""
    best, found = np.full(labels.shape, np.inf), np.zeros(labels.shape, labels.dtype)
    for dy, dx in sorted(disk(reach), key=lambda d: d[0] ** 2 + d[1] ** 2):
        d2 = float(dy * dy + dx * dx)
        near = shifted(labels, dy, dx, 0)
        better = (near > 0) & ((d2 < best) | ((d2 == best) & (near < found)))
        best[better], found[better] = d2, near[better]
    return found, best


def _envelope(f: list[float], far: float) -> list[float]:
    """min over q of (p - q)^2 + f[q] at each p: the lower envelope of these parabolas, from left to right."""
    feet, starts, out = [], [], []
    for q, height in enumerate(f):
        if height >= far:
            continue
        at = -math.inf
        while feet:
            k = feet[-1]
            at = (height + q * q - f[k] - k * k) / (2 * (q - k))
            if at > starts[-1]:
                break
            feet.pop()
            starts.pop()
            at = -math.inf
        feet.append(q)
        starts.append(at)
    if not feet:
        return [far] * len(f)
    i = 0
    for p in range(len(f)):
        while i + 1 < len(feet) and starts[i + 1] < p:
            i += 1
        out.append((p - feet[i]) ** 2 + f[feet[i]])
    return out


def distance_inside(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel of mask to the next one outside: lower envelopes of parabolas, by columns and then by rows."""
    far = float(mask.shape[0] ** 2 + mask.shape[1] ** 2 + 1)
    g = np.where(mask, far, 0.0)
    for _ in range(2):
        lines = g.T
        busy = lines.any(axis=1)
        out = np.zeros(lines.shape)
        for k in np.flatnonzero(busy).tolist():
            out[k] = _envelope(lines[k].tolist(), far)
        g = out
    return np.sqrt(np.minimum(g, far))


def watershed(elevation: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Labels grown from markers in the order of elevation, then of arrival."""
    out = np.where(mask, markers, 0)
    queue = [(float(elevation[y, x]), k, int(y), int(x)) for k, (y, x) in enumerate(zip(*np.nonzero(out), strict=True))]
    heapq.heapify(queue)
    k = len(queue)
    while queue:
        _, _, y, x = heapq.heappop(queue)
        for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                out[a, b] = out[y, x]
                k += 1
                heapq.heappush(queue, (float(elevation[a, b]), k, a, b))
    return out


def peaks(a: np.ndarray, mask: np.ndarray, apart: int = 1) -> np.ndarray:
    """Labels of local maxima within mask."""
    return components4(mask & (a == dilate(a, apart)) & (a > 0))


def split_by_shape(mask: np.ndarray, apart: int = 3) -> np.ndarray:
    """Watershed of the distance to the outside from its peaks; plain parts where there are none."""
    d = distance_inside(mask)
    markers = peaks(d, mask, apart)
    return watershed(-d, markers, mask) if markers.any() else components4(mask)


def regional_maxima(a: np.ndarray) -> np.ndarray:
    """Plateaus (8-connected) without a higher neighbour."""
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    top = a >= np.maximum.reduce([shifted(a, dy, dx, -np.inf) for dy, dx in around])
    while True:
        # a pixel whose equal neighbour isn't one isn't one either
        lost = np.zeros(a.shape, bool)
        for dy, dx in around:
            lost |= (shifted(a, dy, dx, np.nan) == a) & ~shifted(top, dy, dx, True)
        if not (lost & top).any():
            return top
        top &= ~lost


def _split(mask: np.ndarray, touching: bool, apart: int) -> np.ndarray:
    return split_by_shape(mask, apart) if touching else components4(mask)


def threshold_segment(
    image: np.ndarray, threshold: float, dark: bool = False, sigma: float = 3.0, background: float = 0, reconstruction: bool = True, smooth_radius: int = 0,
    fill: bool = True, touching: bool = True, apart: int = 3, refine: bool = True, area: tuple[int, int] = (1, 1 << 30),
) -> np.ndarray:
    """Objects that curve upward and are brighter than the threshold on average.

    The background is taken off, the rest smoothed; where its Laplacian is negative, the response flows to its regional maxima. Regions
    whose mean is over the threshold are accepted, grown by a pixel within the response, filled, and split by their shape. After a wide smoothing
    the borders follow the response of a finer one. Objects stay by area and mean."""
    a = 255.0 - image if dark else image.astype(float)
    if smooth_radius:
        a = median(a, smooth_radius)
    measured = a
    if background:
        under = erode(a, background)
        measured = np.maximum(a - (reconstruct(under, a) if reconstruction else dilate(under, background)), 0.0)
    response = -laplacian(gaussian(measured, sigma, "edge"))
    body = response > 0
    labels = watershed(-response, components4(regional_maxima(response) & body), body)
    bright = _means(labels, measured)[1] > threshold
    bright[0] = False
    merged = stretched(bright[labels]) & body
    if fill:
        merged = fill_holes(merged)
    labels = _split(merged, touching, apart)
    if refine and sigma > 1.5 and labels.any():
        fine = -laplacian(gaussian(a, 1.0, "edge")) > 0
        now = labels > 0
        labels = _split(stretched(now, True) | (now & fine), touching, apart)
    counts, means = _means(labels, measured)
    keep = (counts >= area[0]) & (counts <= area[1]) & (means > threshold)
    keep[0] = False
    number = np.cumsum(keep) * keep
    return number[labels]


def stretched(mask: np.ndarray, inner: bool = False) -> np.ndarray:
    """mask grown by a pixel in all eight directions or, inner, shrunk by one; edges repeated."""
    p = np.pad(mask, 1, mode="edge")
    views = [p[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)]
    return np.logical_and.reduce(views) if inner else np.logical_or.reduce(views)


def _means(labels: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(labels.ravel())
    return counts, np.divide(np.bincount(labels.ravel(), values.ravel()), counts, out=np.zeros(len(counts)), where=counts > 0)


def outline(mask: np.ndarray) -> np.ndarray:
    """Corners (x, y) around the largest 8-connected part's outer border, traced clockwise."""
    labels = parts(mask, True)
    if not labels.any():
        return np.empty((0, 2), int)
    part = np.pad(labels == np.bincount(labels.ravel())[1:].argmax() + 1, 1)
    ring = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    y, x = map(int, np.argwhere(part)[0])
    start, way, out = (y, x), 6, []
    first = None
    while True:
        out.append((x - 1, y - 1))
        for k in range(8):
            turn = (way + 5 + k) % 8
            a, b = y + ring[turn][0], x + ring[turn][1]
            if part[a, b]:
                break
        else:
            break
        if first is None:
            first = (a, b)
        elif (y, x) == start and (a, b) == first:
            out.pop()
            break
        y, x, way = a, b, turn
    return np.array(out)


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed line with the points dropped that lie within tolerance x perimeter of the rest."""
    if len(points) < 3:
        return points
    eps = tolerance * float(np.hypot(*(points - np.roll(points, -1, axis=0)).T).sum())
    far = int(((points - points[0]) ** 2).sum(axis=1).argmax())
    keep = np.zeros(len(points) + 1, bool)
    closed = np.vstack([points, points[:1]])
    keep[[0, far, len(points)]] = True
    todo = [(0, far), (far, len(points))]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d, p = closed[j] - closed[i], closed[i + 1 : j] - closed[i]
        n = float(np.hypot(*d))
        dist = np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / n if n else np.hypot(*p.T)
        k = int(dist.argmax())
        if dist[k] > eps:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep[:-1]]


def segment_tiles(pixels: DataFrame, threshold: float, **how) -> DataFrame:
    """tile, y, x, label of pixels (tile, y, x, value), kernel by tile: a tile with its halo fits one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = int(pdf["y"].min()), int(pdf["x"].min())
        a = np.zeros((int(pdf["y"].max()) - y + 1, int(pdf["x"].max()) - x + 1))
        a[pdf["y"] - y, pdf["x"] - x] = pdf["value"]
        labels = threshold_segment(a, threshold, **how)
        ys, xs = np.nonzero(labels)
        return pd.DataFrame({"tile": pdf["tile"].iloc[0], "y": ys + y, "x": xs + x, "label": labels[ys, xs]})

    ready(pixels.sparkSession)
    return pixels.groupBy("tile").applyInPandas(run, f"tile {dict(pixels.dtypes)['tile']}, y int, x int, label long")


def expand_labels(labels: DataFrame, reach: float) -> DataFrame:
    """y, x, label: every pixel within reach of a label, to the nearest one, ties to the smaller; labelled pixels stay. Each pixel is
    offered to the disk around it and takes the best offer, one aggregate a pixel."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(dy * dy + dx * dx).alias("d2")) for dy, dx in disk(reach)])
    offers = labels.where("label > 0").select("y", "x", "label", F.explode(offsets).alias("o")).select((F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("o.d2").alias("d2"), "label")
    return offers.groupBy("y", "x").agg(F.min(F.struct("d2", "label")).alias("m")).select("y", "x", F.col("m.label").alias("label"), F.col("m.d2").alias("d2"))


def boundaries(labels: DataFrame) -> DataFrame:
    """Labelled pixels with a 4-neighbour of another label; beyond the image counts as another."""
    own = labels.where("label > 0")
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    claims = own.select("label", F.explode(around).alias("o"), "y", "x").select("label", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    same = claims.groupBy("y", "x", "label").agg(F.count("*").alias("n"))
    return own.join(same, ["y", "x", "label"], "left").where(F.coalesce("n", F.lit(0)) < 4).select("y", "x", "label")


def compartments(cells: DataFrame, nuclei: DataFrame, ring: float) -> DataFrame:
    """y, x, cell and the flags nuclear, cytoplasm, ring (cytoplasm within `ring` of the own nucleus) and membrane (on the border)."""
    near = expand_labels(nuclei, ring).select("y", "x", F.col("label").alias("_near"))
    edge = boundaries(cells).select("y", "x", F.lit(True).alias("membrane"))
    own = nuclei.where("label > 0").select("y", "x", F.col("label").alias("_nucleus"))
    out = cells.where("label > 0").join(own, ["y", "x"], "left").join(near, ["y", "x"], "left").join(edge, ["y", "x"], "left")
    nuclear = F.coalesce(F.col("_nucleus") == F.col("label"), F.lit(False))
    return out.select("y", "x", F.col("label").alias("cell"), nuclear.alias("nuclear"), (~nuclear).alias("cytoplasm"), (~nuclear & F.coalesce(F.col("_near") == F.col("label"), F.lit(False))).alias("ring"), F.coalesce("membrane", F.lit(False)).alias("membrane"))
