"""Image sources as pixel or tile tables, dispatched by path, with metadata from headers and XML."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tesserae.functions.geometry import Box
from tesserae.session import ready

#: Suffixes by kind of source, and axes by number of dimensions where a file has none.
TIFF_SUFFIXES = (".tif", ".tiff", ".qptiff", ".btf", ".tf8")
DEFAULT_AXES = {2: "YX", 3: "CYX", 4: "ZCYX", 5: "TZCYX"}


def kind_of(path: str) -> str:
    """zarr, tiff, npy or parquet by suffix; an error for others."""
    low = path.rstrip("/").lower()
    if low.endswith(".zarr"):
        return "zarr"
    if low.endswith(TIFF_SUFFIXES):
        return "tiff"
    if low.endswith((".npy", ".npz")):
        return low[-3:]
    if low.endswith(".parquet"):
        return "parquet"
    raise ValueError(f"no reader for {path}")


def axes_of(ndim: int, axes: str | None = None) -> str:
    if axes:
        if len(axes) != ndim or not {"Y", "X"} <= set(axes):
            raise ValueError("axes don't fit the array")
        return axes
    if ndim not in DEFAULT_AXES:
        raise ValueError(f"{ndim} dimensions")
    return DEFAULT_AXES[ndim]


@dataclass(frozen=True)
class ImageMetadata:
    width: int
    height: int
    channels: tuple[str, ...]
    axes: str = "CYX"
    pixel_size: tuple[float, float] | None = None
    levels: tuple[float, ...] = (1.0,)
    extra: dict = field(default_factory=dict)

    @property
    def channel_count(self) -> int:
        return len(self.channels)

    def row(self, spark: SparkSession) -> DataFrame:
        x, y = self.pixel_size or (None, None)
        return spark.createDataFrame([(self.width, self.height, self.channel_count, self.axes, list(self.channels), x, y)], "width int, height int, channel_count int, axes string, channels array<string>, pixel_size_x double, pixel_size_y double")


def best_level(levels: list[float], wanted: float) -> int:
    """The level whose scale is nearest to the wanted one by ratio, the first on ties."""
    return min(range(len(levels)), key=lambda k: (abs(np.log(wanted / levels[k])), k))


def ome_metadata(xml: Column) -> dict[str, Column]:
    """Channel names and pixel sizes from OME XML, whatever its namespace."""
    bare = F.regexp_replace(F.regexp_replace(xml, r'\sxmlns(:\w+)?="[^"]*"', ""), r"<(/?)\w+:", "<$1")
    return {
        "channels": F.xpath(bare, F.lit("//Pixels/Channel/@Name")),
        "pixel_size_x": F.xpath_double(bare, F.lit("//Pixels/@PhysicalSizeX")),
        "pixel_size_y": F.xpath_double(bare, F.lit("//Pixels/@PhysicalSizeY")),
    }


def qpi_channel(xml: Column) -> Column:
    """A page's channel: what the first of the tags Biomarker, ChannelName and Fluor holds, in any case and with any attributes, without
    tags inside it; null if that is blank. Where the tags have namespaces, the first that isn't blank."""
    # fixed values: how the three tags are matched
    tag = r"(?is)<(?:Biomarker|ChannelName|Fluor)[^>]*>(.*?)</(?:Biomarker|ChannelName|Fluor)>"
    spaced = r"(?i)<\w+:(?:Biomarker|ChannelName|Fluor)(?:\s[^>]*)?>\s*([^<]*[^<\s])"
    held = F.when(xml.rlike(tag), F.regexp_replace(F.regexp_extract(xml, tag, 1), "<[^>]*>", "")).otherwise(F.regexp_extract(xml, spaced, 1))
    return F.nullif(F.trim(held), F.lit(""))


def zarr_pixel_size(attributes: Column) -> Column:
    """(y, x) scale of the first level from .zattrs text, null if either is missing."""
    scale = F.from_json(F.get_json_object(attributes, "$.multiscales[0].datasets[0].coordinateTransformations[0].scale"), "array<double>")
    axes = F.from_json(F.get_json_object(attributes, "$.multiscales[0].axes"), "array<struct<name:string>>")
    at = lambda n: F.try_element_at(scale, F.array_position(F.transform(axes, lambda a: F.lower(a["name"])), n).cast("int"))
    pair = F.struct(at("y").alias("y"), at("x").alias("x"))
    return F.when(pair["y"].isNotNull() & pair["x"].isNotNull(), pair)


def read_arrays(spark: SparkSession, path: str, tile: int = 1024, axes: str | None = None) -> DataFrame:
    """path, channel, row, column, y, x, height, width and values (row by row) of the tiles of .npy files, one task a file.

    TIFF files and Zarr folders are read by tiles.read_image(), segment by segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                yield from (pd.DataFrame([{"path": p, **t}]) for t in read_tiles(a, axes_of(a.ndim, axes), tile))

    ready(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, channel int, row int, column int, y int, x int, height int, width int, values array<double>")


def read_tiles(a: np.ndarray, axes: str, tile: int) -> Iterator[dict]:
    """Tiles of each channel; other axes at their first position."""
    a = np.moveaxis(a, [axes.index(c) for c in ("C", "Y", "X") if c in axes], range(-len([c for c in "CYX" if c in axes]), 0))
    while a.ndim > (3 if "C" in axes else 2):
        a = a[0]
    a = a if "C" in axes else a[None]
    for c in range(a.shape[0]):
        for row, y in enumerate(range(0, a.shape[1], tile)):
            for column, x in enumerate(range(0, a.shape[2], tile)):
                part = a[c, y : y + tile, x : x + tile]
                yield {"channel": c, "row": row, "column": column, "y": y, "x": x, "height": part.shape[0], "width": part.shape[1], "values": part.astype(float).ravel().tolist()}


def pixels(tiles: DataFrame) -> DataFrame:
    """channel, y, x, value rows of tiles."""
    rows = tiles.select("*", F.posexplode("values").alias("_k", "value"))
    return rows.select(*[c for c in ("path", "channel") if c in tiles.columns], (F.col("y") + F.floor(F.col("_k") / F.col("width"))).cast("int").alias("y"), (F.col("x") + F.col("_k") % F.col("width")).cast("int").alias("x"), "value")


def resolve_channels(wanted: list[int | str], names: list[str]) -> list[int]:
    """Positions of channels given by position (negative from the end) or name, in any case."""
    low = [n.lower() for n in names]
    out = []
    for w in wanted:
        if isinstance(w, int):
            k = w + len(names) if w < 0 else w
        else:
            k = names.index(w) if w in names else low.index(w.lower()) if w.lower() in low else -1
        if not 0 <= k < len(names):
            raise ValueError(f"no channel {w}")
        out.append(k)
    return out


def read_region(pixel_rows: DataFrame, x: int, y: int, width: int, height: int, channels: list[int] | None = None) -> DataFrame:
    """Pixels of a region: plain comparisons, which reach the Parquet scan."""
    if width <= 0 or height <= 0:
        raise ValueError("the region is empty")
    out = pixel_rows.where((F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height))
    return out if channels is None else out.where(F.col("channel").isin(channels))


def read_labels(chunks: DataFrame, region: Box, grid: DataFrame) -> DataFrame:
    """y, x, label of a grid's pixels; what no chunk stores is 0."""
    own = chunks.where(region.contains_point(F.col("x"), F.col("y"))).select("y", "x", "label")
    return grid.join(own, ["y", "x"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def read_archives(spark: SparkSession, path: str, version: int = 1, names: DataFrame | None = None) -> DataFrame:
    """Predictions of .npz tile archives (struct of arrays with ragged, packed masks); another schema version is an error.

    names: of the files in the folder `path`, as a column of strings. Each is then opened by the task that has its name, and the driver lists
    none of them."""
    schema = pa.schema([("tile", pa.string()), ("local_index", pa.int64()), ("class_id", pa.int32()), ("score", pa.float64()), *[(c, pa.int64()) for c in ("area", "x0", "y0", "x1", "y1")], ("centroid_x", pa.float64()), ("centroid_y", pa.float64()), ("owned", pa.bool_()), ("at_edge", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])

    def rows(content: bytes) -> pa.RecordBatch:
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            if int(z["schema_version"][0]) != version:
                raise ValueError("the archive has another schema version")
            scores, off, data = z["scores"], z["mask_offsets"], np.ascontiguousarray(z["mask_data"], np.uint8)
            n = len(scores)
            box, centre = z["global_boxes"].reshape(n, 4), z["global_centroids"].reshape(n, 2)
            held = [np.full(n, str(z["tile_id"]), object), np.arange(n), z["class_ids"], scores, z["areas"], *box.T, *centre.T, z["owned_by_core"], z["touches_read_edge"], z["mask_widths"], z["mask_heights"]]
        kinds = ["O", "i8", "i4", "f8", *["i8"] * 5, "f8", "f8", "?", "?", "i4", "i4"]
        columns = [pa.array(np.ascontiguousarray(a, k), t) for a, k, t in zip(held, kinds, schema.types, strict=False)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([data[off[k] : off[k + 1]].tobytes() for k in range(n)], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                yield rows(content.as_py())

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(base)
        for b in batches:
            for name in b.column(0).to_pylist():
                with files.open_input_stream(f"{root}/{name}") as f:
                    yield rows(f.read())

    ready(spark)
    fields = "tile string, local_index long, class_id int, score double, area long, x0 long, y0 long, x1 long, y1 long, centroid_x double, centroid_y double, owned boolean, at_edge boolean, width int, height int, data binary"
    if names is None:
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, fields)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    base = there.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    # names are few bytes for the work that they are
    return names.toDF("name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(opened, fields)


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A measurement CSV, with or without a byte-order mark; only the columns asked for are parsed."""
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})
    return df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns])
