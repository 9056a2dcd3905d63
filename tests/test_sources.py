from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import masks
from tesserae.sources import annotations, images, registry, sinks


def test_coco(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "height": 10, "width": 10}],
        "categories": [{"id": 7, "name": "cat"}, {"id": 3, "name": "dog"}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 7, "bbox": [0, 0, 2, 2], "iscrowd": 0, "segmentation": [[0, 0, 1, 0, 1, 1], [0, 0, 1, 1]], "keypoints": [1, 2, 2]},
            {"id": 2, "image_id": 1, "category_id": 3, "bbox": [0, 0, 2, 2], "iscrowd": 0, "segmentation": [[0, 0, 1, 1]]},
        ],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc))
    _, _, rows = annotations.read_coco(spark, str(tmp_path / "c.json"))
    row = rows.collect()
    assert [(r.id, r["class"], len(r.polygons), r.keypoints) for r in row] == [(1, 1, 1, [1.5, 2.5, 2.0])]
    doc["annotations"].append(doc["annotations"][0])
    (tmp_path / "d.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError):
        annotations.read_coco(spark, str(tmp_path / "d.json"))


def test_voc(spark, tmp_path):
    (tmp_path / "i1.xml").write_text("<annotation><object><name>dog</name><difficult>1</difficult><bndbox><xmin>2</xmin><ymin>3</ymin><xmax>8</xmax><ymax>9</ymax></bndbox></object></annotation>")
    r = annotations.read_voc(spark, str(tmp_path / "i1.xml")).first()
    assert (r.image, r["class"], r.x0, r.y0, r.x1, r.y1, r.difficult) == ("i1", "dog", 1.0, 2.0, 8.0, 9.0, True)


def test_unknown_category_is_an_error(spark):
    rows, cats = spark.createDataFrame([(9,)], "category_id long"), spark.createDataFrame([(1,)], "id long")
    with pytest.raises(Exception, match="unknown category 9"):
        annotations.remap(rows, cats).collect()


def test_arrays_and_regions(spark, tmp_path):
    a = np.arange(2 * 5 * 7).reshape(2, 5, 7).astype(float)
    np.save(tmp_path / "a.npy", a)
    px = images.pixels(images.read_arrays(spark, str(tmp_path / "a.npy"), tile=4))
    got = {(r.channel, r.y, r.x): r.value for r in px.collect()}
    assert got == {(c, y, x): a[c, y, x] for c in range(2) for y in range(5) for x in range(7)}
    assert images.read_region(px, 2, 1, 3, 2, images.resolve_channels([-1], ["a", "b"])).count() == 6
    assert images.resolve_channels(["CD3", 0], ["dapi", "cd3"]) == [1, 0]
    with pytest.raises(ValueError):
        images.kind_of("x.png")


def test_archives(spark, tmp_path):
    bits = np.array([[1, 0], [1, 1]], bool)
    data = np.frombuffer(masks.pack(bits), np.uint8)
    fields = dict(
        schema_version=np.array([1], np.int16), tile_id="t", scores=np.array([0.5], np.float32), class_ids=np.array([2], np.int32), areas=np.array([3]), global_boxes=np.array([[4, 5, 6, 7]]), global_centroids=np.array([[4.3, 5.6]]),
        owned_by_core=np.array([True]), touches_read_edge=np.array([False]), mask_widths=np.array([2], np.int32), mask_heights=np.array([2], np.int32), mask_offsets=np.array([0, len(data)]), mask_data=data,
    )
    np.savez(tmp_path / "t.npz", **fields)
    df = images.read_archives(spark, str(tmp_path / "t.npz"))
    runs = masks.unpack(df.select(F.col("local_index").alias("id"), F.col("x0").cast("int").alias("x"), F.col("y0").cast("int").alias("y"), "width", "height", "data"))
    assert masks.statistics(runs).first().area == df.first().area == 3


def test_metadata_xml(spark):
    xml = '<OME xmlns="u"><Image><Pixels PhysicalSizeX="0.5" PhysicalSizeY="0.25"><Channel Name="DAPI"/><Channel Name="CD3"/></Pixels></Image></OME>'
    r = spark.createDataFrame([(xml, "<P><Biomarker></Biomarker><ChannelName>Opal</ChannelName></P>")], "x string, q string").select(*[c.alias(n) for n, c in images.ome_metadata(F.col("x")).items()], images.qpi_channel(F.col("q")).alias("q")).first()
    assert (list(r.channels), r.pixel_size_x, r.pixel_size_y, r.q) == (["DAPI", "CD3"], 0.5, 0.25, None)
    pages = ["<p><fluor id='1'>A <b>1</b></FLUOR><Biomarker>B</Biomarker></p>", "<p>none</p>", "<q:p><q:Fluor> </q:Fluor><q:BIOMARKER a='1'> CD8 </q:BIOMARKER></q:p>", "<ChannelName>\nOpal 520\n</ChannelName>"]
    got = spark.createDataFrame(list(enumerate(pages)), "k int, q string").select("k", images.qpi_channel(F.col("q")).alias("v")).orderBy("k").collect()
    assert [(x.v or "").strip() or None for x in got] == ["A 1", None, "CD8", "Opal 520"]
    z = '{"multiscales":[{"axes":[{"name":"c"},{"name":"y"},{"name":"x"}],"datasets":[{"coordinateTransformations":[{"type":"scale","scale":[1,0.3,0.4]}]}]}]}'
    assert tuple(spark.createDataFrame([(z,)], "z string").select(images.zarr_pixel_size(F.col("z")).alias("p")).first().p) == (0.3, 0.4)


def test_catalog(spark):
    c = registry.Catalog()
    c.register("n", lambda s: s.range(3), kind="x")
    assert c.get(spark, "n", view=True).count() == 3 and spark.table("n").count() == 3
    with pytest.raises(ValueError):
        c.register("n", lambda s: s.range(1))
    with pytest.raises(KeyError, match="there are n"):
        c.get(spark, "m")
    with pytest.raises(ValueError):
        c.metadata("n").put(kind="y")
    c.remove("n")
    assert c.names() == []


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "a")], "id int, s string")
    sinks.write_csv(df, str(tmp_path / "o"), ["id"])
    back = images.read_features(spark, str(tmp_path / "o"), ["id"])
    assert [r.id for r in back.collect()] == ["1", "2"]
    poly = spark.createDataFrame([(1, 5, 0, [0.0, 2.0, 2.0], [0.0, 0.0, 2.0], 2.0, [0.0, 0.0, 2.0, 2.0])], "id long, image_id long, category_id int, xs array<double>, ys array<double>, area double, bbox array<double>")
    sinks.coco_document(df, df.limit(0), sinks.coco_annotations(poly), str(tmp_path / "c.json"))
    doc = json.loads((tmp_path / "c.json").read_text())
    assert doc["annotations"][0]["segmentation"] == [[0.0, 0.0, 2.0, 0.0, 2.0, 2.0]] and doc["categories"] == []
    labels = spark.createDataFrame([(0, 0, 1), (5, 5, 0), (9, 1, 2)], "y int, x int, label long")
    sinks.write_label_chunks(labels, str(tmp_path / "l"), 4)
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2
