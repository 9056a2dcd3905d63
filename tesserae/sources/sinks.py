"""Writers: wide tables, sheets, annotation JSON, label chunks, manifests. Spark's committers make them atomic."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.operators.cells import in_turn
from tesserae.operators.sampling import numbered
from tesserae.session import at_most, ready, written

#: Rows and columns of a spreadsheet.
SHEET_ROWS, SHEET_COLUMNS = 1_048_576, 16_384


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Nulls as empty fields; in order, if asked for, across part files."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def sheets(df: DataFrame, order: list[str], rows: int = SHEET_ROWS) -> DataFrame:
    """df with the sheet (from 1) each row goes to, a header row in each; too many columns are an error."""
    if len(df.columns) > SHEET_COLUMNS:
        raise ValueError(f"more than {SHEET_COLUMNS} columns")
    return numbered(df, order, "_k").withColumn("sheet", (F.floor((F.col("_k") - 1) / (rows - 1)) + 1).cast("long")).drop("_k")


def write_sheets(df: DataFrame, path: str, order: list[str], rows: int = SHEET_ROWS) -> None:
    sheets(df, order, rows).write.mode("overwrite").partitionBy("sheet").option("header", True).csv(path)


def coco_rows(instances: DataFrame) -> DataFrame:
    """image_id, category_id, bbox (x, y, width, height), score as COCO's results have them."""
    bbox = F.array("x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return instances.select("image_id", "category_id", F.transform(bbox, lambda v: F.round(v.cast("double"), 3)).alias("bbox"), "score")


def coco_annotations(polygons: DataFrame) -> DataFrame:
    """annotation ids from 1 by image and object, with area and bbox to three places."""
    rows = numbered(polygons, ["image_id", "id"], "annotation_id")
    flat = F.flatten(F.zip_with("xs", "ys", lambda x, y: F.array(x, y)))
    return rows.select(F.col("annotation_id").alias("id"), "image_id", "category_id", F.array(flat).alias("segmentation"), F.round("area", 3).alias("area"), F.transform("bbox", lambda v: F.round(v, 3)).alias("bbox"), F.lit(0).alias("iscrowd"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def coco_document(images: DataFrame, categories: DataFrame, annotations: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One document of three lists, for tools that read no other: it goes through the driver, row by row, to any file system that Spark
    knows, under another name until it is whole. More than `most` rows are refused; write_json_lines() writes them in parts."""
    tables = (("images", images), ("categories", categories), ("annotations", annotations))
    for name, df in tables:
        if not at_most(df, most):
            raise ValueError(f"more than {most} {name}: write them in parts")
    spark = images.sparkSession
    there, made = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.part"))
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    out = spark._jvm.java.io.PrintStream(system.create(made, True), False, "UTF-8")
    out.print("{")
    for k, (name, df) in enumerate(tables):
        out.print(("," if k else "") + json.dumps(name) + ":[")
        for i, row in enumerate(df.toJSON().toLocalIterator()):
            out.print(("," if i else "") + row)
        out.print("]")
    out.print("}")
    out.close()
    system.delete(there, False)
    system.rename(made, there)


def coco_documents(images: DataFrame, categories: DataFrame, annotations: DataFrame, folder: str, rows: int = 50_000) -> None:
    """The three lists in a folder of documents in COCO's form, for read_coco(folder): each holds rows of one list, `rows` or about so many,
    and is written by a task of its own, so any number of rows stays off the driver and no document is larger than a task can read."""
    names = ("images", "categories", "annotations")

    def document(name: str):
        before = "".join(f'"{n}":[],' for n in names if n != name)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([f'{{{before}"{name}":['])], ["value"])
            first = True
            for b in batches:
                lines = b.column(0).to_pylist()
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([x if first and not i else f",{x}" for i, x in enumerate(lines)])], ["value"])
                    first = False
            yield pa.RecordBatch.from_arrays([pa.array(["]}"])], ["value"])

        return run

    ready(images.sparkSession)
    for name, df in zip(names, (images, categories, annotations), strict=True):
        lines = written(df.select(F.to_json(F.struct(*df.columns)).alias("value")), name)
        parts = max(1, -(-lines.count() // rows))
        lines.repartition(parts).mapInArrow(document(name), "value string").write.mode("overwrite" if name == names[0] else "append").text(folder)


def _at(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small document as write_text() writes."""
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, default=str))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file under another name until it is whole, then in the place of the old one."""
    there, system = _at(spark, path)
    made, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = system.create(made, True)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()
    system.delete(there, False)
    if not system.rename(made, there):
        raise OSError(f"{path} can't be written")


def read_json(spark: SparkSession, path: str):
    """What write_json() wrote; None if there is nothing."""
    there, system = _at(spark, path)
    if not system.exists(there):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def remove(spark: SparkSession, path: str) -> None:
    there, system = _at(spark, path)
    system.delete(there, True)


#: Columns of the table of global cells, in order.
CELL_COLUMNS = ("global_cell_id", "class_id", "class_name", "score", "area", "centroid_x", "centroid_y", "x0", "y0", "x1", "y1", "source_count", "owned_source_count", "touches_image_edge", "representative_prediction_id", "mask_strategy")


def write_cells(cells: DataFrame, path: str) -> None:
    """The table of global cells by number; columns that cells lacks are empty."""
    rows = cells.select(*[F.col(c) if c in cells.columns else F.lit(None).cast("string").alias(c) for c in CELL_COLUMNS])
    write_csv(rows, path, ["global_cell_id"])


def write_archives(instances: DataFrame, folder: str, compressed: bool = True) -> DataFrame:
    """One .npz a tile of instances (tile_id, local_index, score, class_id, area, x0, y0, x1, y1, centroid_x, centroid_y, owned_by_core,
    touches_read_edge, width, height, data: packed bits), in the form that images.read_archives() reads. Returns tile_id, path and count.

    An archive is written under the attempt's name and then takes its own, so one that is there is whole. A tile is one task's: it holds what
    one read of an image found."""
    fields = {"scores": ("score", np.float32), "class_ids": ("class_id", np.int32), "areas": ("area", np.int64), "owned_by_core": ("owned_by_core", bool), "touches_read_edge": ("touches_read_edge", bool), "mask_widths": ("width", np.int32), "mask_heights": ("height", np.int32)}
    there, system = _at(instances.sparkSession, folder)
    system.mkdirs(there)
    base = there.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        files, root = fs.FileSystem.from_uri(base)
        for key, own in in_turn(batches, ["tile_id"]):
            column = lambda c, kind: own.column(c).to_numpy().astype(kind)  # noqa: B023, E731
            data = own.column("data").to_pylist()
            held = {name: column(c, kind) for name, (c, kind) in fields.items()}
            held |= {"schema_version": np.array([1], np.int16), "tile_id": np.array(str(key[0])), "global_boxes": np.column_stack([column(c, np.int64) for c in ("x0", "y0", "x1", "y1")]), "global_centroids": np.column_stack([column(c, float) for c in ("centroid_x", "centroid_y")]), "mask_offsets": np.cumsum([0, *map(len, data)]), "mask_data": np.frombuffer(b"".join(data), np.uint8)}
            packed = io.BytesIO()
            (np.savez_compressed if compressed else np.savez)(packed, **held)
            name = f"{root}/{key[0]}.npz"
            part = f"{name}.{TaskContext.get().taskAttemptId()}.part"
            with files.open_output_stream(part) as out:
                out.write(packed.getvalue())
            files.move(part, name)
            tile = own.column("tile_id").slice(0, 1).combine_chunks()
            yield pa.RecordBatch.from_arrays([tile, pa.array([name]), pa.array([own.num_rows])], ["tile_id", "path", "n"])

    spark = ready(instances.sparkSession)
    # an exchange of a given number of parts: tiles are small for the work that they are
    dealt = instances.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tile_id").sortWithinPartitions("tile_id", "local_index")
    return written(dealt.mapInArrow(run, f"tile_id {dict(instances.dtypes)['tile_id']}, path string, n long"), "archives")


def write_tiffs(pixels: DataFrame, folder: str, height: int, width: int, dtype: str = "uint16", key: str = "image") -> DataFrame:
    """One TIFF an image of pixels (key, channel, y, x, value), a page a channel; absent pixels are 0. An image is one task's, as a region of
    interest or a tile is. Returns key and path."""
    from tesserae.session import ready

    there, system = _at(pixels.sparkSession, folder)
    system.mkdirs(there)
    base = there.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()

    def run(given: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs
        from pyspark import TaskContext

        from tesserae.sources.tiles import encode_tiff

        a = np.zeros((int(pdf["channel"].max()) + 1, height, width), dtype)
        a[pdf["channel"], pdf["y"], pdf["x"]] = pdf["value"]
        files, root = fs.FileSystem.from_uri(base)
        name = f"{root}/{given[0]}.tif"
        part = f"{name}.{TaskContext.get().taskAttemptId()}.part"
        with files.open_output_stream(part) as out:
            out.write(encode_tiff(a))
        files.move(part, name)
        return pd.DataFrame({key: [given[0]], "path": [name]})

    ready(pixels.sparkSession)
    return written(pixels.select(key, "channel", "y", "x", "value").groupBy(key).applyInPandas(run, f"{key} {dict(pixels.dtypes)[key]}, path string"), "tiffs")


def write_label_chunks(labels: DataFrame, path: str, chunk: int = 1024) -> None:
    """Labelled pixels by chunk; an empty chunk has no folder."""
    rows = labels.where("label > 0").withColumn("chunk_y", F.floor(F.col("y") / chunk)).withColumn("chunk_x", F.floor(F.col("x") / chunk))
    rows.write.mode("overwrite").partitionBy("chunk_y", "chunk_x").parquet(path)


def write_failures(units: DataFrame, path: str) -> bool:
    """Failed units and their errors; nothing is written if there are none."""
    bad = units.where("state = 'failed'").select("unit", "attempt", "error")
    if bad.limit(1).count() == 0:
        return False
    write_csv(bad, path)
    return True


def roi_manifest(rois: DataFrame, image: str) -> DataFrame:
    return rois.select("roi_id", F.lit(image).alias("image"), "row", "column", "x0", "y0", "width", "height", "pad_right", "pad_bottom", F.format_string("%s_%s.tif", F.lit(image), F.col("roi_id")).alias("file"))
