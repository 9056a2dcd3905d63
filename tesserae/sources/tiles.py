"""A data source for large images: TIFF and BigTIFF (strips or tiles, raw or deflated), Zarr version 2 (raw or zlib chunks) and .npy.

    spark.dataSource.register(TileSource)
    spark.read.format("tesserae_tiles").option("path", p).option("region", "x,y,width,height").option("channels", "0,2").load()

A row is one stored segment of one channel, cut to the region: path, level, channel, row, column, y, x, height, width and values (row by
row). Segments outside the region, other channels and other levels are never read, and filters on channel, row, column and level take
segments out before they are planned. A partition holds `batch` segments. Only headers are read on the driver; other codecs are an error that
names them. Places are pixels of the level; `region` is of the level too.

Files are reached through pyarrow's file systems, so executors read the bytes of their segments and no more.
"""

from __future__ import annotations

import ast
import json
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "path string, level int, channel int, row int, column int, y int, x int, height int, width int, values array<double>"
#: Fixed values of the format: bytes of a field's types, by number, and their codes for struct.
FIELD = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
#: Fixed values of the format: numbers of the fields that are read.
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 270, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SUB_IFDS, SAMPLE_FORMAT = 322, 323, 324, 325, 330, 339


def open_file(path: str):
    from pyarrow import fs

    scheme, _, rest = path.partition("://")
    if rest and scheme in ("s3a", "s3n"):
        path = f"s3://{rest}"
    system, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(base)


@dataclass(frozen=True)
class Segment(InputPartition):
    """A stored piece: where its bytes are, its place on the level, its stored shape and how it is coded."""

    path: str
    level: int
    channels: tuple[int, ...]  # of the samples that it holds, in order
    row: int
    column: int
    y: int
    x: int
    stored: tuple[int, int]
    height: int  # without what lies beyond the image
    width: int
    dtype: str
    codec: str  # raw or zlib
    predictor: int
    offset: int
    length: int  # of the bytes; -1 for the whole file


def ifds(data) -> tuple[str, list[dict[int, tuple]]]:
    """Byte order and the fields of each directory, sub-directories after their own, of an open TIFF or BigTIFF."""
    size = data.size()
    order = {b"II": "<", b"MM": ">"}.get(data.read_at(2, 0))
    if order is None:
        raise ValueError("not a TIFF file")
    version = struct.unpack(order + "H", data.read_at(2, 2))[0]
    if version not in (42, 43):
        raise ValueError(f"TIFF version {version}")
    big = version == 43
    n_code, entry, place = ("Q", 20, "Q") if big else ("H", 12, "I")
    n_size, p_size = struct.calcsize(n_code), struct.calcsize(place)
    out, todo, seen = [], [struct.unpack(order + place, data.read_at(p_size, 8 if big else 4))[0]], set()
    while todo:
        at = todo.pop(0)
        if not at or at in seen:
            continue
        if at >= size:
            raise ValueError("a directory lies beyond the file")
        seen.add(at)
        n = struct.unpack(order + n_code, data.read_at(n_size, at))[0]
        raw = data.read_at(n * entry + p_size, at + n_size)
        fields: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, k * entry)
            if kind not in FIELD:
                continue
            length = FIELD[kind][0] * count
            value = raw[k * entry + entry - p_size :][:length] if length <= p_size else data.read_at(length, struct.unpack_from(order + place, raw, k * entry + entry - p_size)[0])
            fields[tag] = (value.rstrip(b"\0"),) if kind == 2 else struct.unpack(order + FIELD[kind][1] * count, value)
        out.append(fields)
        todo = [*fields.get(SUB_IFDS, ()), struct.unpack_from(order + place, raw, n * entry)[0], *todo]
    return order, out


def _tiff_segments(path: str) -> list[Segment]:
    with open_file(path) as data:
        order, pages = ifds(data)
    out: list[Segment] = []
    sizes: list[tuple[int, int]] = []
    used: dict[int, int] = {}
    for f in pages:
        width, height = f[WIDTH][0], f[HEIGHT][0]
        if (height, width) not in sizes:
            sizes.append((height, width))
        level = sizes.index((height, width))
        samples, planar = f.get(SAMPLES, (1,))[0], f.get(PLANAR, (1,))[0]
        first = used.get(level, 0)
        used[level] = first + samples
        bits, kind = set(f.get(BITS, (1,))), {1: "u", 2: "i", 3: "f"}.get(f.get(SAMPLE_FORMAT, (1,))[0])
        codec = {1: "raw", 8: "zlib", 32946: "zlib"}.get(f.get(COMPRESSION, (1,))[0])
        predictor = f.get(PREDICTOR, (1,))[0]
        if codec is None or kind is None or len(bits) > 1 or next(iter(bits)) % 8 or predictor > 2:
            raise ValueError(f"{path}: compression {f.get(COMPRESSION)}, {f.get(BITS)} bits, predictor {predictor}: no reader for these")
        dtype = f"{order}{kind}{next(iter(bits)) // 8}"
        if TILE_OFFSETS in f:
            shape, offsets, counts = (f[TILE_HEIGHT][0], f[TILE_WIDTH][0]), f[TILE_OFFSETS], f[TILE_COUNTS]
        else:
            shape, offsets, counts = (min(height, f.get(ROWS, (height,))[0]), width), f[OFFSETS], f[COUNTS]
        down, across = math.ceil(height / shape[0]), math.ceil(width / shape[1])
        for plane in range(samples if planar == 2 else 1):
            channels = (first + plane,) if planar == 2 else tuple(range(first, first + samples))
            for k in range(down * across):
                row, column = divmod(k, across)
                y, x, i = row * shape[0], column * shape[1], plane * down * across + k
                own = min(shape[0], height - y), min(shape[1], width - x)
                # the last strip is stored as short as it is, a tile never
                out.append(Segment(path, level, channels, row, column, y, x, shape if TILE_OFFSETS in f else own, *own, dtype, codec, predictor, offsets[i], counts[i]))
    return out


def describe(path: str) -> dict:
    """width, height, channels, dtype and levels (their scales) of a TIFF file or Zarr folder, and a TIFF's description; by headers only."""
    from tesserae.sources.images import kind_of

    tiff = kind_of(path) == "tiff"
    found = _tiff_segments(path) if tiff else _zarr_segments(path, None)
    extent = lambda level: tuple(max(at + own for at, own in x) for x in zip(*[((s.y, s.height), (s.x, s.width)) for s in found if s.level == level], strict=True))
    sizes = [extent(k) for k in sorted({s.level for s in found})]
    out = {"height": sizes[0][0], "width": sizes[0][1], "channels": 1 + max(c for s in found if s.level == 0 for c in s.channels), "dtype": found[0].dtype.split("|u", 1)[0].split("|")[0] if tiff else found[0].dtype.rsplit("|", 3)[0]}
    out["levels"] = [sizes[0][1] / w for _, w in sizes]
    if tiff:
        with open_file(path) as data:
            out["description"] = ifds(data)[1][0].get(DESCRIPTION, (b"",))[0].decode("utf-8", "replace")
    return out


def encode_tiff(planes_: np.ndarray, tile: int = 256, description: str = "") -> bytes:
    """A TIFF of (channels, height, width): a page a channel, in deflated tiles."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link, kind = 4, {"u": 1, "i": 2, "f": 3}[planes_.dtype.kind]
    for n, page in enumerate(np.ascontiguousarray(planes_.astype(planes_.dtype.newbyteorder("<")))):
        offsets, counts = [], []
        for y in range(0, page.shape[0], tile):
            for x in range(0, page.shape[1], tile):
                part = page[y : y + tile, x : x + tile]
                raw = zlib.compress(np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]))).tobytes(), 6)
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw
        fields = [(WIDTH, 4, [page.shape[1]]), (HEIGHT, 4, [page.shape[0]]), (BITS, 3, [8 * page.dtype.itemsize]), (COMPRESSION, 3, [8]), (262, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1])]
        fields += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts), (SAMPLE_FORMAT, 3, [kind])]
        entries = []
        for tag, code, values in fields:
            entries.append((tag, code, len(values), struct.pack("<" + FIELD[code][1] * len(values), *values)))
        if description and not n:
            text = description.encode() + b"\0"
            entries.append((DESCRIPTION, 2, len(text), text))
        made = []
        for tag, code, count, raw in sorted(entries):
            if len(raw) > 4:
                at = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack("<I", at)
            made.append(struct.pack("<HHI", tag, code, count) + raw.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(made)) + b"".join(made)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def _npy_segments(path: str, axes: str | None, rows: int = 256) -> list[Segment]:
    """An array file's channels in strips of rows; other axes at their first position."""
    from tesserae.sources.images import axes_of

    with open_file(path) as data:
        head = data.read_at(min(data.size(), 4096), 0)
    major = head[6]
    size = struct.unpack_from("<H" if major == 1 else "<I", head, 8)[0]
    begin = (10 if major == 1 else 12) + size
    about = ast.literal_eval(head[begin - size : begin].decode("latin-1"))
    shape, order = about["shape"], axes_of(len(about["shape"]), axes)
    if about["fortran_order"] or order[-2:] != "YX":
        raise ValueError(f"{path}: only rows that lie one after another are read in parts")
    step = np.dtype(about["descr"]).itemsize
    plane = shape[-1] * shape[-2] * step
    ahead = {c: math.prod(shape[k + 1 : -2]) for k, c in enumerate(order[:-2])}
    out = []
    for c in range(shape[order.index("C")] if "C" in order else 1):
        for row, y in enumerate(range(0, shape[-2], rows)):
            own = min(rows, shape[-2] - y), shape[-1]
            out.append(Segment(path, 0, (c,), row, 0, y, 0, own, *own, about["descr"], "raw", 1, begin + c * ahead.get("C", 0) * plane + y * shape[-1] * step, own[0] * own[1] * step))
    return out


def _zarr_json(path: str) -> dict | None:
    try:
        with open_file(path) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def _zarr_segments(path: str, axes: str | None) -> list[Segment]:
    from tesserae.sources.images import axes_of

    path = path.rstrip("/")
    attributes = _zarr_json(f"{path}/.zattrs") or {}
    scales = (attributes.get("multiscales") or [{}])[0]
    names = [d["path"] for d in scales.get("datasets", [])] or [""]
    named = "".join(str(a["name"] if isinstance(a, dict) else a).upper() for a in scales.get("axes", [])) or axes
    out = []
    for level, name in enumerate(names):
        base = f"{path}/{name}".rstrip("/")
        array = _zarr_json(f"{base}/.zarray")
        if array is None:
            raise ValueError(f"{base} holds no array of version 2")
        codec = (array.get("compressor") or {}).get("id", "raw")
        if codec not in ("raw", "zlib") or array.get("filters") or array.get("order", "C") != "C":
            raise ValueError(f"{base}: compressor {codec}, filters {array.get('filters')}, order {array.get('order')}: no reader for these")
        shape, chunks, order = array["shape"], array["chunks"], axes_of(len(array["shape"]), named)
        sep = array.get("dimension_separator", ".")
        at = {c: order.index(c) for c in "CYX" if c in order}
        n_channels = shape[at["C"]] if "C" in at else 1
        thick = chunks[at["C"]] if "C" in at else 1
        for c in range(math.ceil(n_channels / thick)):
            for row in range(math.ceil(shape[at["Y"]] / chunks[at["Y"]])):
                for column in range(math.ceil(shape[at["X"]] / chunks[at["X"]])):
                    place = [0] * len(shape)
                    place[at["Y"]], place[at["X"]] = row, column
                    if "C" in at:
                        place[at["C"]] = c
                    y, x = row * chunks[at["Y"]], column * chunks[at["X"]]
                    # other axes at their first position: the chunk's first plane of them
                    own = tuple(range(c * thick, min(n_channels, (c + 1) * thick)))
                    layout = f"{array['dtype']}|{order}|{','.join(map(str, chunks))}|{json.dumps(array.get('fill_value'))}"
                    out.append(Segment(f"{base}/{sep.join(map(str, place))}", level, own, row, column, y, x, (chunks[at["Y"]], chunks[at["X"]]), min(chunks[at["Y"]], shape[at["Y"]] - y), min(chunks[at["X"]], shape[at["X"]] - x), layout, codec, 1, 0, -1))
    return out


def planes(s: Segment) -> np.ndarray:
    """(channels, height, width) of a segment, as floating point."""
    if s.length >= 0:
        with open_file(s.path) as f:
            raw = f.read_at(s.length, s.offset)
        raw = zlib.decompress(raw) if s.codec == "zlib" else raw
        a = np.frombuffer(raw, s.dtype)[: s.stored[0] * s.stored[1] * len(s.channels)].reshape(*s.stored, len(s.channels))
        if s.predictor == 2:
            a = np.cumsum(a, axis=1, dtype=a.dtype)
        return np.moveaxis(a, 2, 0)[:, : s.height, : s.width].astype(float)
    dtype, order, chunks, fill = s.dtype.split("|", 3) if not s.dtype.startswith("|") else ("|" + s.dtype[1:].split("|", 1)[0], *s.dtype[1:].split("|", 3)[1:])
    shape, empty = tuple(map(int, chunks.split(","))), json.loads(fill)
    try:
        with open_file(s.path) as f:
            raw = f.read()
        a = np.frombuffer(zlib.decompress(raw) if s.codec == "zlib" else raw, dtype).reshape(shape)
    except FileNotFoundError:  # a chunk that holds the fill value only
        a = np.full(shape, 0 if empty is None else float(empty))
    axes = [order.index(c) for c in "CYX" if c in order]
    a = np.moveaxis(a, axes, range(-len(axes), 0)).reshape(-1, *[shape[k] for k in axes])[0]
    a = a if "C" in order else a[None]
    return a[: len(s.channels), : s.height, : s.width].astype(float)


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tesserae_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)


@dataclass(frozen=True)
class Batch(InputPartition):
    segments: tuple[Segment, ...]


class TileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.axes = options.get("axes")
        self.batch = int(options.get("batch", "8"))
        self.level = int(options.get("level", "0"))
        numbers = lambda name: tuple(map(int, options[name].split(","))) if name in options else None
        self.region, self.channels = numbers("region"), numbers("channels")
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("channel", "row", "column", "level"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
                if f.attribute[0] == "level" and len(values) == 1:
                    self.level = next(iter(values))
            yield f  # Spark tests the rows once more: a stored segment may hold several channels

    def partitions(self) -> list[Batch]:
        from tesserae.sources.images import kind_of

        kind = kind_of(self.path)
        readers = {"zarr": lambda: _zarr_segments(self.path, self.axes), "tiff": lambda: _tiff_segments(self.path), "npy": lambda: _npy_segments(self.path, self.axes)}
        if kind not in readers:
            raise ValueError(f"no tiles in a file of kind {kind}")
        found = readers[kind]()

        def needed(s: Segment) -> bool:
            if s.level != self.level or not set(s.channels) & self._channels(s):
                return False
            if any(getattr(s, k) not in self.wanted[k] for k in ("row", "column", "level") if k in self.wanted):
                return False
            if self.region is None:
                return True
            x, y, w, h = self.region
            return s.x < x + w and s.x + s.width > x and s.y < y + h and s.y + s.height > y

        own = [s for s in found if needed(s)]
        return [Batch(tuple(own[k : k + self.batch])) for k in range(0, len(own), self.batch)]

    def _channels(self, s: Segment) -> set[int]:
        out = set(s.channels) if self.channels is None else set(s.channels) & set(self.channels)
        return out & self.wanted["channel"] if "channel" in self.wanted else out

    def read(self, partition: Batch) -> Iterator[tuple]:
        for s in partition.segments:
            held, takes = planes(s), self._channels(s)
            x, y, w, h = self.region or (s.x, s.y, s.width, s.height)
            x0, y0, x1, y1 = max(x, s.x), max(y, s.y), min(x + w, s.x + s.width), min(y + h, s.y + s.height)
            for k, channel in enumerate(s.channels):
                if channel in takes:
                    part = held[k, y0 - s.y : y1 - s.y, x0 - s.x : x1 - s.x]
                    yield self.path, s.level, channel, s.row, s.column, y0, x0, y1 - y0, x1 - x0, part.ravel().tolist()


def read_image(spark: SparkSession, path: str, **options):
    """Tiles of a TIFF file or Zarr folder; options as above. Filters are pushed into the source."""
    from tesserae.session import ready

    ready(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileSource)
    reader = spark.read.format("tesserae_tiles").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v if isinstance(v, str) else ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v))
    return reader.load()
