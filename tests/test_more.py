from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import nested
from tesserae.operators import evaluation, joins, masks, matching, raster, regions, runs
from tesserae.sources import annotations, builtin, images, sinks
from tesserae.sources.registry import Catalog


def grid(spark, a: np.ndarray, name: str = "label"):
    ys, xs = np.nonzero(np.ones(a.shape, bool))
    return spark.createDataFrame([(int(y), int(x), float(a[y, x]) if a.dtype.kind == "f" else int(a[y, x])) for y, x in zip(ys, xs, strict=True)], f"y int, x int, {name} {'double' if a.dtype.kind == 'f' else 'long'}")


def held(df, shape) -> np.ndarray:
    out = np.zeros(shape, np.int64)
    for r in df.collect():
        if 0 <= r.y < shape[0] and 0 <= r.x < shape[1]:
            out[r.y, r.x] = r.label
    return out


@pytest.fixture(scope="module")
def nuclei():
    a = np.zeros((60, 70), np.int64)
    a[10:20, 10:20], a[12:18, 32:40], a[40:50, 15:25], a[41:47, 50:58] = 1, 2, 3, 4
    return a


def test_regions_nuclear_fixed(spark, nuclei):
    df = grid(spark, nuclei)
    assert np.array_equal(held(regions.grow(df, "nuclear"), nuclei.shape), nuclei)
    assert np.array_equal(held(regions.grow(df, "fixed", 6), nuclei.shape), raster.nearest(nuclei, 6)[0])
    with pytest.raises(ValueError):
        regions.grow(df, "else")


def test_regions_voronoi(spark, nuclei):
    centroids = spark.createDataFrame([(1, 14.4, 14.6), (2, 15.0, 36.0), (3, 15.0, 36.0)], "label long, centroid_y double, centroid_x double")
    got = held(regions.grow(grid(spark, nuclei), "voronoi", 12, centroids), nuclei.shape)
    ys, xs = np.nonzero(nuclei == 4)
    points = {1: (14, 15), 2: (15, 36), 3: (40, 15), 4: (ys[len(ys) // 2], xs[len(xs) // 2])}
    want = np.zeros_like(nuclei)
    for y in range(60):
        for x in range(70):
            d, k = min(((y - py) ** 2 + (x - px) ** 2, k) for k, (py, px) in points.items())
            want[y, x] = k if d <= 144 else 0
    want[nuclei > 0] = nuclei[nuclei > 0]
    assert np.array_equal(got, want)


def test_regions_watershed_doesn_t_depend_on_chunks(spark, nuclei):
    membrane = np.zeros(nuclei.shape)
    membrane[:, 26], membrane[30, :] = 1.0, 1.0
    whole = regions.flood(nuclei, membrane, 8, 0.0)
    got = held(regions.grow(grid(spark, nuclei), "watershed", 8, membrane=grid(spark, membrane, "value"), chunk=512), nuclei.shape)
    assert np.array_equal(got, whole) and np.array_equal(whole[nuclei > 0], nuclei[nuclei > 0])
    assert (got[10:20, 21:24] == 1).all() and got[15, 31] == 2 and (got[raster.nearest(nuclei, 8)[0] == 0] == 0).all()
    assert regions.halo(8, 0) == 10 and regions.halo(8, 1.5) == 15


def test_polygons_to_runs(spark):
    rng = np.random.default_rng(1)
    shapes = [(i, (rng.random(7) * 30 - 5).tolist(), (rng.random(7) * 30 - 5).tolist()) for i in range(12)] + [(50, [0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 3.0, 3.0]), (51, [1.0, 2.0], [1.0, 2.0])]
    got = {(r.id, r.y, r.x) for r in masks.to_pixels(masks.from_polygons(spark.createDataFrame(shapes, "id long, xs array<double>, ys array<double>"))).collect()}

    def inside(px, py, xs, ys) -> bool:
        odd = False
        for k in range(len(xs)):
            ax, ay, bx, by = xs[k - 1], ys[k - 1], xs[k], ys[k]
            if (ay <= py) != (by <= py) and px >= ax + (py - ay) * (bx - ax) / (by - ay):
                odd = not odd
        return odd

    want = {(i, y, x) for i, xs, ys in shapes if len(xs) > 2 for y in range(-8, 30) for x in range(-8, 30) if inside(x + 0.5, y + 0.5, xs, ys)}
    assert got == want and sum(k[0] == 50 for k in got) == 12


def test_nested(spark):
    df = spark.createDataFrame([(1, (2.0, ("x", 3)), [("k", 5)])], "a int, b struct<c:double,d:struct<e:string,drop:int>>, l array<struct<n:string,drop:int>>")
    flat = nested.flattened(df)
    assert flat.columns == ["a", "b/c", "b/d/e", "b/d/drop", "l"] and flat.first()[2] == "x"
    out = df.select(nested.without(df, "b", "drop"), nested.without(df, "l", "drop")).first()
    assert out.b.asDict(True) == {"c": 2.0, "d": {"e": "x"}} and [x.asDict() for x in out.l] == [{"n": "k"}]
    text = spark.createDataFrame([('{"a":{"t":1,"b":2},"t":3}',)], "s string")
    assert text.select(nested.json_without(F.col("s"), "struct<a:struct<t:int,b:int>,t:int>", "t").alias("s")).first().s == '{"a":{"b":2}}'
    assert nested.table_text(df.select("a")) == "| a |\n|---|\n| 1 |"


def test_panoptic_json(spark, tmp_path):
    doc = {"annotations": [{"image_id": 7, "file_name": "a.b.png", "segments_info": [{"id": 3, "category_id": 90, "area": 5, "bbox": [0, 0, 1, 1], "iscrowd": 0}, {"id": 4, "category_id": 2, "area": 1, "bbox": [0, 0, 1, 1]}]}, {"image_id": 8, "file_name": "c.png", "segments_info": []}], "categories": [{"id": 90, "name": "sky", "isthing": 0}, {"id": 2, "name": "car", "isthing": 1}, {"id": 1, "name": "man", "isthing": 1}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    found, categories = annotations.read_panoptic(spark, str(tmp_path / "p.json"), "/i", "/t")
    rows = {r.image_id: r for r in found.collect()}
    assert rows[7].file_name == "/i/a.b.jpg" and rows[7].pan_seg_file_name == "/t/a.b.png" and rows[8].segments == []
    assert [(s.id, s["class"], s.isthing, s.iscrowd) for s in rows[7].segments] == [(3, 0, False, 0), (4, 1, True, 0)]
    assert {(r.name, r["class"]) for r in categories.collect()} == {("sky", 0), ("man", 0), ("car", 1)}
    doc["annotations"][0]["segments_info"][0]["category_id"] = 5
    (tmp_path / "q.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="unknown category"):
        annotations.read_panoptic(spark, str(tmp_path / "q.json"), "/i", "/t")[0].collect()
    px = spark.createDataFrame([(1, 2, 3)], "red int, green int, blue int")
    assert annotations.segment_pixels(px).first().segment == 1 + 2 * 256 + 3 * 65536


def test_objects_in_front_hide_those_behind(spark):
    square = lambda a, b: [[float(x), float(y)] for x, y in ((a, a), (b, a), (b, b), (a, b))]
    rows = [("f", 20, 20, 0, "front", square(2, 6)), ("f", 20, 20, 1, "back", square(0, 10)), ("g", 20, 20, 0, "other", square(0, 3))]
    df = spark.createDataFrame(rows, "file string, imgHeight int, imgWidth int, order int, label string, polygon array<array<double>>")
    seen = annotations.visible_polygons(df).groupBy("file", "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"), F.max("y").alias("y")).collect()
    assert {(r.file, r.label, r.n, r.y) for r in seen} == {("f", "front", 16, 5), ("f", "back", 84, 9), ("g", "other", 9, 2)}


def test_truths_by_file(spark):
    det = spark.createDataFrame([("a", 1), ("a", 2)], "file_name string, id int")
    sem = spark.createDataFrame([("a", "s")], "file_name string, sem_seg_file_name string")
    assert [r.sem_seg_file_name for r in annotations.merged_truths(det, sem).collect()] == ["s", "s"]
    with pytest.raises(Exception, match="no semantic truth"):
        annotations.merged_truths(det, sem.limit(0)).collect()


def test_builtin_registrations(spark, tmp_path):
    catalog = Catalog()
    names = builtin.register_builtin(catalog, str(tmp_path))
    assert len(names) == len(set(names)) == 9 + 7 + 6 + 10 + 6 + 7 + 2
    assert catalog.metadata("coco_2017_val_100")["json_file"].endswith("coco/annotations/instances_val2017_100.json") and catalog.metadata("coco_2014_valminusminival")["image_root"].endswith("coco/val2014")
    assert catalog.metadata("coco_2017_test-dev")["json_file"].endswith("image_info_test-dev2017.json")
    folder = tmp_path / "VOC2007"
    (folder / "ImageSets/Main").mkdir(parents=True)
    (folder / "Annotations").mkdir()
    (folder / "ImageSets/Main/val.txt").write_text("i1\n")
    for n in ("i1", "i2"):
        (folder / f"Annotations/{n}.xml").write_text("<annotation><object><name>cat</name><difficult>0</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    assert [r.image for r in catalog.get(spark, "voc_2007_val").collect()] == ["i1"]


def test_small_documents_and_cells(spark, tmp_path):
    path = str(tmp_path / "c.json")
    assert sinks.read_json(spark, path) is None
    sinks.write_json(spark, path, {"a": 1})
    sinks.write_json(spark, path, {"a": [2, "é"]})
    assert sinks.read_json(spark, path) == {"a": [2, "é"]} and not list(tmp_path.glob("*.part"))
    cells = spark.createDataFrame([(2, 0.5), (1, 0.25)], "global_cell_id long, score double")
    sinks.write_cells(cells, str(tmp_path / "cells"))
    back = spark.read.option("header", True).csv(str(tmp_path / "cells"))
    assert tuple(back.columns) == sinks.CELL_COLUMNS and len(back.columns) == 16 and [r.global_cell_id for r in back.collect()] == ["1", "2"]


def test_archives_round_trip(spark, tmp_path):
    rows = []
    for t in range(2):
        for k in range(3):
            bits = np.random.default_rng(10 * t + k).random((4, 5)) < 0.5
            rows.append((f"t{t}", k, 0.5, 1, int(bits.sum()), 10 * k, 0, 10 * k + 5, 4, 1.5, 2.5, True, False, 5, 4, bytearray(masks.pack(bits))))
    df = spark.createDataFrame(rows, "tile_id string, local_index int, score double, class_id int, area long, x0 long, y0 long, x1 long, y1 long, centroid_x double, centroid_y double, owned_by_core boolean, touches_read_edge boolean, width int, height int, data binary")
    made = sinks.write_archives(df, str(tmp_path / "a"))
    assert sorted((r.tile_id, r.n) for r in made.collect()) == [("t0", 3), ("t1", 3)] and not list((tmp_path / "a").glob("*.part"))
    back = images.read_archives(spark, str(tmp_path / "a" / "*.npz"))
    assert sorted((r.tile, r.local_index, r.area, bytes(r.data)) for r in back.collect()) == sorted((r[0], r[1], r[4], bytes(r[-1])) for r in rows)


def side(spark, rows, extra: str):
    return spark.createDataFrame(rows, f"image int, class int, id int, {extra}, x0 double, y0 double, x1 double, y1 double")


def test_coco_by_size_and_report(spark):
    box = lambda x, s: (float(x), 0.0, float(x + s), float(s))
    gt = side(spark, [(1, 0, 1, False, *box(0, 10)), (1, 0, 2, False, *box(100, 50)), (1, 1, 3, False, *box(300, 200)), (1, 0, 4, True, *box(600, 60))], "crowd boolean")
    det = side(spark, [(1, 0, 1, 0.9, *box(0, 10)), (1, 0, 2, 0.8, *box(700, 10)), (1, 1, 3, 0.7, *box(300, 190)), (1, 0, 5, 0.95, *box(610, 20))], "score double")
    got = {r.metric: r.value for r in evaluation.coco_report(gt, det, names=spark.createDataFrame([(0, "cat"), (1, "dog")], "class int, name string")).collect()}
    assert set(got) == {"AP", "AP50", "AP75", "APs", "APm", "APl", "AP-cat", "AP-dog"}
    half = 100 * 51 / 101  # one of two truths found first: recalls 0 to 0.5
    dog = 100 * 9 / 10  # IoU 0.9025 passes 0.50 to 0.90
    assert got["AP-cat"] == pytest.approx(half) and got["AP-dog"] == pytest.approx(dog) and got["AP"] == pytest.approx((half + dog) / 2)
    # the false detection is small: it counts among small objects; the middle truth was missed
    assert got["APs"] == pytest.approx(100.0) and got["APm"] == 0.0 and got["APl"] == pytest.approx(dog)


def test_rotated_coco(spark):
    rows = [(1, 0, 1, 50.0, 50.0, 40.0, 10.0, 30.0), (1, 0, 2, 150.0, 50.0, 40.0, 10.0, 0.0)]
    gt = spark.createDataFrame(rows, "image int, class int, id int, cx double, cy double, w double, h double, angle double")
    det = spark.createDataFrame([(*r[:3], 0.9, *r[3:]) for r in rows[:1]] + [(1, 0, 2, 0.8, 150.0, 50.0, 40.0, 10.0, 90.0)], "image int, class int, id int, score double, cx double, cy double, w double, h double, angle double")
    got = {r.metric: r.value for r in evaluation.coco_report(gt, det, rotated=True).collect()}
    assert got["AP"] == pytest.approx(100 * 51 / 101) and matching.rotated_iou(np.array([[150, 50, 40, 10, 0.0]]), np.array([[150, 50, 40, 10, 90.0]]))[0, 0] == pytest.approx(100 / 700)


def test_lvis_report(spark):
    box = lambda x: (float(x), 0.0, float(x + 10), 10.0)
    gt = side(spark, [(1, 0, 1, False, *box(0)), (2, 1, 2, False, *box(0))], "crowd boolean")
    det = side(spark, [(1, 0, 1, 0.9, *box(0)), (3, 0, 2, 0.95, *box(0)), (2, 1, 3, 0.5, *box(0)), (2, 1, 4, 0.9, *box(50)), (1, 1, 5, 0.99, *box(80))], "score double")
    none = spark.createDataFrame([], "image int, class int")
    counts = spark.createDataFrame([(0, 5), (1, 500)], "class int, images long")
    value = lambda neg, loose: {r.metric: r.value for r in evaluation.lvis_report(gt, det, neg, loose, counts).collect()}
    got = value(none, none)
    assert got["APr"] == pytest.approx(100) and got["APf"] == pytest.approx(50) and math.isnan(got["APc"]) and got["AP"] == pytest.approx(75)
    assert value(spark.createDataFrame([(3, 0)], "image int, class int"), none)["APr"] == pytest.approx(50)
    assert value(none, spark.createDataFrame([(2, 1)], "image int, class int"))["APf"] == pytest.approx(100)


def test_voc_over_thresholds(spark):
    gt = side(spark, [(1, 0, 1, False, 0.0, 0.0, 99.0, 99.0), (1, 0, 2, True, 200.0, 0.0, 299.0, 99.0), (1, 0, 3, False, 400.0, 0.0, 499.0, 99.0)], "difficult boolean")
    det = side(spark, [(1, 0, 1, 0.9004, 0.0, 0.0, 99.0, 69.0), (1, 0, 2, 0.9, 200.0, 0.0, 299.0, 99.0), (1, 0, 3, 0.5, 400.04, 0.0, 499.0, 99.0)], "score double")
    got = {round(r.iou_step, 2): r.ap for r in evaluation.voc_report(gt, det).collect()}
    assert len(got) == 10
    for t in (0.5, 0.6, 0.65):
        assert got[t] == pytest.approx(1.0)
    for t in (0.75, 0.9, 0.95):  # the first detection is wrong, the second is right: precision 1/2 at recall 1/2
        assert got[t] == pytest.approx(0.25)
    one = {r["class"]: r.ap for r in evaluation.average_precision(evaluation.precision_recall(evaluation.voc_matches(gt, det, 0.5), gt.groupBy("class").agg(F.count_if(~F.col("difficult")).alias("npos")))).collect()}
    assert one[0] == pytest.approx(got[0.5])


def test_evaluators(spark):
    count = evaluation.Evaluator(lambda df: df.agg(F.count("*").cast("double").alias("value")).select(F.lit("n").alias("metric"), "value"))
    total = evaluation.Evaluator(lambda df: df.agg(F.sum("v").cast("double").alias("value")).select(F.lit("sum").alias("metric"), "value"))
    both = evaluation.Evaluators({"a": count, "b": total})
    with pytest.raises(ValueError):
        both.evaluate()
    for k in (1, 2):
        both.process(spark.range(k).selectExpr("id + 1 as v"))
    assert {(r.task, r.metric, r.value) for r in both.evaluate().collect()} == {("a", "n", 3.0), ("b", "sum", 4.0)}
    both.reset()
    both.process(spark.range(1).selectExpr("id as v"))
    assert both.evaluate().where("metric = 'n'").first().value == 1.0
    twice = evaluation.Evaluators({"a": count, "b": count})
    with pytest.raises(ValueError, match="more than once"):
        twice.evaluate()


def test_neighbours_of_vectors(spark):
    v = np.random.default_rng(3).normal(size=(50, 4))
    got = joins.knn_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>"), 5, block=7).collect()
    want = {(i, int(j)) for i in range(50) for j in sorted((k for k in range(50) if k != i), key=lambda k: ((v[i] - v[k]) ** 2).sum())[:5]}
    assert {(r.a, r.b) for r in got} == want


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.random() * 300), float(rng.random() * 300), float(5 * (i % 3) + rng.random()), float(5 * (i % 2) + rng.random())) for i in range(120)]
    return spark.createDataFrame(rows, "id long, x double, y double, f double, g double")


@pytest.mark.parametrize("method", ["kmeans", "graph"])
def test_clustering_run(spark, cells, tmp_path, method):
    options = runs.ClusterOptions(("f", "g"), components=2, method=method, clusters=6, neighbours=8)
    found = runs.cluster(cells, options)
    rows = found["assignments"].collect()
    assert len(rows) == 120 and {"cluster_id", "cluster_name", "pca1", "pca2", "f", "x"} <= set(found["assignments"].columns)
    kinds: dict = {}
    for r in rows:
        kinds.setdefault(r.cluster_id, set()).add((r.id % 3, r.id % 2))
    assert sum(r.cell_count for r in found["summary"].collect()) == 120 and found["preprocessing"].count() == 2
    if method == "graph":
        assert all(len(k) == 1 for k in kinds.values())
    paths = runs.export(spark, found, str(tmp_path / "out"), options, cell_count=120)
    assert spark.read.option("header", True).csv(paths["assignments"]).count() == 120
    assert sinks.read_json(spark, str(tmp_path / "out/config.json"))["options"]["method"] == method
    with pytest.raises(ValueError, match="unknown features"):
        runs.cluster(cells, runs.ClusterOptions(("f", "no")))


def test_spatial_run_and_viewer(spark, cells, tmp_path):
    nodes = cells.selectExpr("id", "x", "y", "cast(id % 3 + 1 as int) as cluster_id", "concat('C', id % 3 + 1) as cluster_name")
    found = runs.spatial(nodes, runs.GraphOptions("radius", 20.0, physical=True), pixel_size=0.5)
    pts = {r.id: (r.x, r.y) for r in cells.collect()}
    want = {(a, b) for a in pts for b in pts if a < b and math.dist(pts[a], pts[b]) <= 40}
    edges = found["edges"].collect()
    assert {(r.source, r.target) for r in edges} == want and all(r.distance_physical == pytest.approx(r.distance / 2) for r in edges)
    assert sum(r.observed for r in found["counts"].collect()) == len(want)
    for method in ("knn", "delaunay"):
        assert runs.spatial(nodes, runs.GraphOptions(method, 30.0, 3))["edges"].count() > 100
    with pytest.raises(ValueError):
        runs.spatial(nodes, runs.GraphOptions(physical=True))
    folder, plain = str(tmp_path / "view"), found["edges"].select("source", "target", "distance")
    assert runs.viewer_index(nodes, plain, folder, 64.0) and not runs.viewer_index(nodes, plain, folder, 64.0)
    seen, lines = runs.viewport(spark, folder, 50, 60, 150, 140)
    assert {r.id for r in seen.collect()} == {i for i, (x, y) in pts.items() if 50 <= x <= 150 and 60 <= y <= 140}
    meets = lambda a, b: min(pts[a][0], pts[b][0]) <= 150 and max(pts[a][0], pts[b][0]) >= 50 and min(pts[a][1], pts[b][1]) <= 140 and max(pts[a][1], pts[b][1]) >= 60
    assert sorted((r.source, r.target) for r in lines.collect()) == sorted(e for e in want if meets(*e))
    assert runs.viewer_index(nodes, plain.where("distance < 20"), folder, 64.0)
