"""Sources and sinks: what the tables hold is written in a format, read back by its reader, and must be what it was."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tesserae.operators import masks, runs
from tesserae.plans.registry import big, query, r, table
from tesserae.plans.spatial import BOXES, box_mask, boxes, label_pixels, points
from tesserae.session import fresh_dir
from tesserae.sources import annotations, images, sinks, tiles

IMAGE = "px AS (SELECT o_orderkey // 100 AS y, o_orderkey % 100 AS x, o_custkey % 7 AS label, o_custkey % 3 AS image FROM orders)"


@query(f"WITH {IMAGE} SELECT image, y, x, CAST(label AS DOUBLE) AS value FROM px WHERE label > 0 AND x >= 10 AND x < 60 AND y >= 2 AND y < 202")
def tiff_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images written as TIFF, a region of each read: only the stored tiles that it meets."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    px = table(spark, sf_dir, "orders").select((c % 3).alias("image"), F.lit(0).alias("channel"), F.floor(k / 100).alias("y"), (k % 100).alias("x"), (c % 7).alias("value"))
    files = sinks.write_tiffs(px, fresh_dir(spark, "tiff"), px.agg(F.max("y") + 1).first()[0] or 1, 100)
    out = None
    for f in files.orderBy("image").collect():  # three images
        own = images.pixels(tiles.read_image(spark, f["path"], region=(10, 2, 50, 200))).where("value > 0").select(F.lit(f["image"]).alias("image"), big("y").alias("y"), big("x").alias("x"), "value")
        out = own if out is None else out.unionAll(own)
    return out


@query(f"WITH {BOXES} SELECT id, class_id, x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x1 - x0)::DOUBLE AS w, (y1 - y0)::DOUBLE AS h FROM boxes WHERE id % 5 > 0")
def coco_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COCO documents of all boxes; every fifth has a polygon of too few points and goes."""
    rows = boxes(spark, sf_dir)
    corner = [F.col(c).cast("double") for c in ("x0", "y0", "x1", "y0", "x1", "y1")]
    polygon = F.when(F.col("id") % 5 == 0, F.array(*corner[:4])).otherwise(F.array(*corner))
    notes = rows.select("id", F.col("tile").alias("image_id"), (F.col("class_id") * 10 + 3).cast("long").alias("category_id"), F.array(polygon).alias("segmentation"), F.array(*[F.col(c).cast("double") for c in ("x0", "y0")], (F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double")).alias("bbox"), F.lit(0).alias("iscrowd"))
    pictures = rows.select(F.col("tile").alias("id"), F.concat(F.lit("i"), F.col("tile").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(2003).alias("height"), F.lit(1501).alias("width")).distinct()
    kinds = rows.select((F.col("class_id") * 10 + 3).cast("long").alias("id"), F.concat(F.lit("c"), F.col("class_id").cast("string")).alias("name")).distinct()
    folder = fresh_dir(spark, "coco")
    sinks.coco_documents(pictures, kinds, notes, folder)
    found = annotations.read_coco(spark, folder)[2]
    return found.select("id", F.col("class").cast("int").alias("class_id"), *[F.col("bbox")[k].alias(c) for k, c in enumerate(("x0", "y0", "w", "h"))])


@query(f"WITH {BOXES} SELECT 'i' || id // 50 AS image, 'c' || class_id AS class, (x0 - 1)::DOUBLE AS x0, (y0 - 1)::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, id % 3 = 0 AS difficult FROM boxes")
def voc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XML file for each fifty boxes."""
    rows = boxes(spark, sf_dir)
    text = F.format_string("<object><name>c%d</name><difficult>%d</difficult><bndbox><xmin>%d</xmin><ymin>%d</ymin><xmax>%d</xmax><ymax>%d</ymax></bndbox></object>", "class_id", F.when(F.col("id") % 3 == 0, 1).otherwise(0), "x0", "y0", "x1", "y1")
    folder = fresh_dir(spark, "voc")
    files = rows.groupBy(F.floor(F.col("id") / 50).alias("image")).agg(F.array_join(F.collect_list(text), "").alias("t"))
    for row in files.toLocalIterator():
        sinks.write_text(spark, f"{folder}/i{row['image']}.xml", f"<annotation>{row['t']}</annotation>")
    return annotations.read_voc(spark, f"{folder}/*.xml")


@query(f"""
    WITH {BOXES}, o AS (SELECT *, id // 50 AS image, row_number() OVER (PARTITION BY id // 50 ORDER BY id DESC) - 1 AS front FROM boxes)
    SELECT image, CAST(front AS INT) AS "order", 'c' || class_id AS label, x1 - x0 AS width, y1 - y0 AS height FROM o
""")
def cityscapes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon files, one for each fifty boxes; objects that come later stand in front."""
    folder = fresh_dir(spark, "city")
    files = boxes(spark, sf_dir).groupBy(F.floor(F.col("id") / 50).alias("image")).agg(F.sort_array(F.collect_list(F.struct("id", "class_id", "x0", "y0", "x1", "y1"))).alias("held"))
    for row in files.toLocalIterator():
        objects = [{"label": f"c{b['class_id']}", "polygon": [[b["x0"], b["y0"]], [b["x1"], b["y0"]], [b["x1"], b["y1"]], [b["x0"], b["y1"]]]} for b in row["held"]]
        sinks.write_text(spark, f"{folder}/t{row['image']}_polygons.json", json.dumps({"imgHeight": 2100, "imgWidth": 1600, "objects": objects}))
    found = annotations.read_cityscapes(spark, f"{folder}/*_polygons.json")
    ends = lambda k, f: f(F.transform("polygon", lambda p: p[k]))
    width, height = (ends(k, F.array_max) - ends(k, F.array_min) for k in (0, 1))
    return found.select(F.regexp_extract("file", r"t(\d+)_polygons", 1).cast("long").alias("image"), "order", "label", width.cast("long").alias("width"), height.cast("long").alias("height"))


@query("""
    SELECT n_nationkey AS image_id, '/i/n' || n_nationkey || '.jpg' AS file_name, CAST(count(*) FILTER (s_suppkey % 4 < 2) AS INT) AS things, CAST(count(*) FILTER (s_suppkey % 4 >= 2) AS INT) AS stuff,
           CAST(coalesce(sum(s_suppkey % 2), 0) AS BIGINT) AS classes
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey
""")
def panoptic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as images, suppliers as segments of four categories: 10 and 11 are things, 12 and 13 stuff, each counted from 0."""
    held: dict[int, list] = {n["n_nationkey"]: [] for n in table(spark, sf_dir, "nation").collect()}
    for s in table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").toLocalIterator():
        held[s["s_nationkey"]].append({"id": s["s_suppkey"], "category_id": 10 + s["s_suppkey"] % 4, "area": 1, "bbox": [0, 0, 1, 1], "iscrowd": 0})
    doc = {"annotations": [{"image_id": n, "file_name": f"n{n}.png", "segments_info": v} for n, v in held.items()], "categories": [{"id": 10 + k, "name": f"c{k}", "isthing": int(k < 2)} for k in range(4)]}
    path = f"{fresh_dir(spark, 'panoptic')}/p.json"
    sinks.write_text(spark, path, json.dumps(doc))
    found = annotations.read_panoptic(spark, path, "/i", "/t")[0]
    count = lambda flag: F.size(F.filter("segments", lambda s: s["isthing"] == flag))
    return found.select("image_id", "file_name", count(True).alias("things"), count(False).alias("stuff"), F.aggregate(F.transform("segments", lambda s: s["class"]), F.lit(0).cast("long"), lambda a, x: a + x).alias("classes"))


RUNS = "runs AS (SELECT id, class_id, score, y0, y1, x0, x1, unnest(range(y0, y1)) AS y FROM boxes), shaped AS (SELECT id, class_id, score, y, x0 + 2 * (y % 2) AS x0, x1 FROM runs)"


@query(f"WITH {BOXES}, {RUNS} SELECT 't' || id // 50 AS tile, row_number() OVER (PARTITION BY id // 50 ORDER BY id) - 1 AS local_index, class_id, sum(x1 - x0)::BIGINT AS area, min(x0) AS x0, min(y) AS y0 FROM shaped GROUP BY id, class_id")
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks packed into archives, one a tile, and read back: areas come from the bits."""
    # a file of boxes is small for the work that they are, so they are dealt before each becomes a list of runs
    own = boxes(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    shapes = own.select(F.concat(F.lit("t"), F.floor(F.col("id") / 50).cast("string")).alias("tile_id"), F.col("id").alias("local_index"), "score", "class_id", F.lit(True).alias("owned_by_core"), F.lit(False).alias("touches_read_edge"), box_mask().alias("mask"))
    folder = fresh_dir(spark, "npz")
    made = sinks.write_archives(masks.packed(shapes), folder)
    found = images.read_archives(spark, folder, names=made.select(F.concat("tile_id", F.lit(".npz"))))
    return masks.measured(found.select("tile", "local_index", "class_id", F.col("x0").alias("x"), F.col("y0").alias("y"), "width", "height", "data"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measurement table written as CSV with a byte-order mark; two of its columns read."""
    folder = fresh_dir(spark, "csv")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("﻿id"), F.col("s_acctbal").alias("Mean, x"), F.col("s_nationkey").alias("nation"))
    sinks.write_csv(rows, folder)
    return images.read_features(spark, folder, ["id", "nation"])


@query("""
    SELECT s_suppkey AS id, 'DAPI,CD' || s_suppkey AS channels, round((s_suppkey % 7) / 8, 6) AS pixel_size_x, 0.5::DOUBLE AS pixel_size_y,
           CASE s_suppkey % 4 WHEN 0 THEN 'Opal ' || s_suppkey WHEN 1 THEN 'CD' || s_suppkey ELSE NULL END AS page_channel, round((s_suppkey % 5) / 4, 6) AS scale_y, round((s_suppkey % 3) / 2, 6) AS scale_x FROM supplier
""")
def image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels and pixel sizes from three kinds of headers."""
    k = F.col("s_suppkey").cast("string")
    size = lambda n, d: (F.col("s_suppkey") % n / d).cast("string")
    xml = F.concat(F.lit('<ome:OME xmlns:ome="u"><ome:Image><ome:Pixels PhysicalSizeX="'), size(7, 8), F.lit('" PhysicalSizeY="0.5"><ome:Channel Name="DAPI"/><ome:Channel Name="CD'), k, F.lit('"/></ome:Pixels></ome:Image></ome:OME>'))
    page: Column = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("<p><fluor a='1'>Opal <b>"), k, F.lit("</b></FLUOR><Biomarker>x</Biomarker></p>"))).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("<p><ChannelName> CD"), k, F.lit(" </ChannelName></p>"))).when(F.col("s_suppkey") % 4 == 2, F.lit("<p><Biomarker></Biomarker><Fluor>x</Fluor></p>")).otherwise(F.lit("<p/>"))
    attributes = F.concat(F.lit('{"multiscales":[{"axes":[{"name":"c"},{"name":"y"},{"name":"x"}],"datasets":[{"path":"0","coordinateTransformations":[{"type":"scale","scale":[1,'), size(5, 4), F.lit(","), size(3, 2), F.lit("]}]}]}]}"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), xml.alias("xml"), page.alias("page"), attributes.alias("zattrs"))
    about, scale = images.ome_metadata(F.col("xml")), images.zarr_pixel_size(F.col("zattrs"))
    return rows.select("id", F.array_join(about["channels"], ",").alias("channels"), r(about["pixel_size_x"], 6).alias("pixel_size_x"), about["pixel_size_y"].alias("pixel_size_y"), images.qpi_channel(F.col("page")).alias("page_channel"), r(scale["y"], 6).alias("scale_y"), r(scale["x"], 6).alias("scale_x"))


@query("WITH l AS (SELECT o_orderkey // 100 AS y, o_orderkey % 100 AS x, o_custkey % 7 AS label FROM orders) SELECT y, x, label FROM l WHERE label > 0 AND x < 60 AND y >= 10 AND y < 90")
def label_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written by chunk; those of a region read: other chunks' folders are pruned."""
    folder = fresh_dir(spark, "chunks")
    sinks.write_label_chunks(label_pixels(spark, sf_dir), folder, 32)
    back = spark.read.parquet(folder).where("chunk_x <= 1 and chunk_y <= 2")
    return images.read_region(back, 0, 10, 60, 80).select(big("y").alias("y"), big("x").alias("x"), big("label").alias("label"))


@query("""
    WITH points AS (SELECT p_partkey AS id, CAST((p_partkey * 7919) % 1000 AS DOUBLE) AS x, CAST((p_partkey * 104729 + p_size * 13) % 1000 AS DOUBLE) AS y FROM part),
    e AS (SELECT a.id AS source, b.id AS target, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM points a JOIN points b ON a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400)
    SELECT source, target FROM e WHERE least(ax, bx) <= 400 AND greatest(ax, bx) >= 250 AND least(ay, by_) <= 500 AND greatest(ay, by_) >= 300
""")
def viewer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of a radius graph, indexed by grid cell, in a viewport."""
    folder = fresh_dir(spark, "viewer")
    runs.viewer_index_radius(points(spark, sf_dir), 20.0, folder, 128.0)
    return runs.viewport(spark, folder, 250, 300, 400, 500)[1].select("source", "target")
