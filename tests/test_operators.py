"""Hand-computed fixtures and invariants of the engine's operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import geometry, scalar
from tesserae.operators import evaluation, graph, joins, masks, matching, phenotype, quantify, raster, reconcile, sampling, tiling
from tesserae.streaming import incremental, tracking


def test_tile_grid_by_hand(spark):
    rows = tiling.tile_grid(tiling.one_image(spark, 1000, 700), tiling.TileOptions(256, overlap_ratio=0.1)).collect()
    assert len(rows) == 15
    assert sorted({r.x0 for r in rows}) == [0, 230, 460, 690, 744]
    assert sorted({r.cx0 for r in rows} | {r.cx1 for r in rows}) == [0, 243, 473, 703, 845, 1000]
    assert sorted({r.cy0 for r in rows} | {r.cy1 for r in rows}) == [0, 243, 465, 700]
    assert sum((r.cx1 - r.cx0) * (r.cy1 - r.cy0) for r in rows) == 700_000
    assert all(r.x0 <= r.cx0 and r.cx1 <= r.x1 and r.y0 <= r.cy0 and r.cy1 <= r.y1 for r in rows)


def test_ownership_is_half_open_and_unique(spark):
    options = tiling.TileOptions(256, overlap_ratio=0.1)
    pts = spark.createDataFrame([(243.0, 0.0), (242.9, 242.9), (999.0, 699.0), (0.0, 465.0)], "x double, y double")
    got = [(r.column, r.row) for r in tiling.own(pts, 1000, 700, options).collect()]
    assert got == [(1, 0), (0, 0), (4, 2), (0, 2)]


def test_small_image_is_one_tile(spark):
    rows = tiling.tile_grid(tiling.one_image(spark, 100, 80), tiling.TileOptions(256)).collect()
    assert [(r.x0, r.x1, r.cy0, r.cy1) for r in rows] == [(0, 100, 0, 80)]


def test_bad_options():
    for bad in (dict(tile=0), dict(tile=10, overlap_px=10), dict(tile=10, overlap_ratio=1.0)):
        with pytest.raises(ValueError):
            tiling.TileOptions(**bad)
    with pytest.raises(ValueError):
        reconcile.ReconcileOptions(0, 0)


def test_quantification_by_hand(spark):
    px = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 30.0), (2, 5.0), (2, 5.0), (0, 1.0), (0, 3.0)], "cell int, v double")
    bg = quantify.background(px.withColumn("ch", F.lit(0)), "ch", "v", F.col("cell") == 0).first()
    rows = {r.cell: r for r in quantify.metrics(quantify.partials(px.where("cell > 0"), ["cell"], "v", 10.0), F.lit(bg.background_mean)).collect()}
    assert (rows[1]["mean"], rows[1]["sum"], rows[1]["min"], rows[1]["max"], rows[1]["corrected_mean"]) == (20, 60, 10, 30, 18)
    assert math.isclose(rows[1]["std"], math.sqrt(200 / 3)) and math.isclose(rows[1]["positive_fraction"], 2 / 3)
    assert (rows[2]["std"], rows[2]["positive_fraction"], rows[2]["corrected_mean"]) == (0, 0, 3)


def test_partials_merge_to_the_whole(spark):
    px = spark.range(500).select((F.col("id") % 7).alias("cell"), (F.col("id") * 37 % 101).cast("double").alias("v"), (F.col("id") % 4).alias("chunk"))
    whole = {r.cell: r for r in quantify.partials(px, ["cell"], "v", 50.0).collect()}
    merged = {r.cell: r for r in quantify.merge(quantify.partials(px, ["cell", "chunk"], "v", 50.0).drop("chunk"), ["cell"]).collect()}
    assert {k: tuple(v) for k, v in whole.items()} == {k: tuple(v) for k, v in merged.items()}


def test_feature_columns():
    cols = ["id", "DAPI__mean", "CD3__mean", "CD3__std"]
    assert quantify.default_features(cols) == ["CD3__mean"]
    assert quantify.default_features(["dapi__mean"]) == ["dapi__mean"]


def test_winsor_bounds(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,), (None,)], "v double")
    row = phenotype.fit(df.where("v is not null"), ["v"]).first()
    assert math.isclose(row.winsor_low, 1.015) and math.isclose(row.winsor_high, 8.925)


def test_duplicate_chain_is_one_group(spark):
    rows = [(1, 1, 0, 1.0, 100, 0, 0, 10, 10), (2, 2, 0, 1.0, 100, 5, 0, 15, 10), (3, 1, 0, 1.0, 100, 10, 0, 20, 10), (4, 1, 0, 1.0, 100, 500, 0, 510, 10)]
    boxes = spark.createDataFrame(rows, "id long, tile int, class_id int, score double, area long, x0 long, y0 long, x1 long, y1 long")
    found = reconcile.links(boxes, reconcile.ReconcileOptions(0.3, 0.65, bucket=8))
    got = {(r.a, r.b): (r.intersection, round(r.iou, 4), r.containment) for r in found.collect()}
    assert got == {(1, 2): (50, 0.3333, 0.5), (2, 3): (50, 0.3333, 0.5)}
    grouped = reconcile.groups(boxes.withColumn("owned", F.lit(True)).withColumn("at_edge", F.lit(False)).withColumn("centroid_x", F.col("x0")).withColumn("centroid_y", F.col("y0")), found)
    cells = reconcile.global_cells(grouped).orderBy("global_cell_id").collect()
    assert [(r.global_cell_id, r.representative, r.source_count) for r in cells] == [(1, 1, 3), (2, 4, 1)]


def test_masks_by_runs(spark):
    px = [(1, y, x) for y in range(3) for x in range(4)] + [(2, y, x) for y in range(1, 4) for x in range(2, 6)]
    runs = masks.to_runs(spark.createDataFrame(px, "id long, y long, x long"))
    s = {r.id: r for r in masks.statistics(runs).collect()}
    assert (s[1].area, s[1].centroid_x, s[1].centroid_y, s[1].x1, s[1].y1) == (12, 1.5, 1.0, 4, 3)
    o = masks.overlaps(runs, spark.createDataFrame([(1, 2)], "a long, b long")).first()
    assert o.intersection == 4 and math.isclose(o.iou, 4 / 20)
    u = masks.union(runs, spark.createDataFrame([(1, 9), (2, 9)], "id long, group long"))
    assert masks.statistics(u).first().area == 20
    painted = masks.paint(runs, spark.createDataFrame([(1, 0.5), (2, 0.9)], "id long, score double"))
    assert masks.conflicts(painted).first().conflicts == 4
    assert painted.where("label = 2").count() == 12


def test_unpacked_masks_round_trip(spark):
    rng = np.random.default_rng(0)
    bits = rng.random((5, 7)) > 0.4
    bits[0, 0] = bits[4, 6] = True
    df = spark.createDataFrame([(7, 10, 20, 7, 5, bytearray(masks.pack(bits)))], "id long, x int, y int, width int, height int, data binary")
    got = {(r.y - 20, r.x - 10) for r in masks.to_pixels(masks.unpack(df)).collect()}
    assert got == set(map(tuple, np.argwhere(bits).tolist()))


def test_enrichment_by_hand(spark):
    counts = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 2, 1)], "a int, b int, observed long")
    rows = {(r.a, r.b): (round(r.expected, 4), round(r.ratio, 4)) for r in graph.enrichment(counts).collect()}
    assert rows == {(1, 1): (0.6, 1.6667), (1, 2): (1.8, 0.5556), (2, 2): (0.6, 1.6667)}


def test_knn_union_by_hand(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (3, 3.0, 0.0)], "id long, x double, y double")
    assert sorted((r.source, r.target) for r in graph.knn_graph(pts, 1, 1.0).collect()) == [(0, 1), (1, 3)]


def test_knn_against_brute_force(spark):
    rnd = random.Random(1)
    pts = [(i, rnd.choice([rnd.random() * 10, 500 + rnd.random()]), rnd.random() * 3) for i in range(90)] + [(90, 5.0, 1.0), (91, 5.0, 1.0)]
    got = {(r.a, r.rank): r.b for r in joins.knn(spark.createDataFrame(pts, "id long, x double, y double"), 3, 0.5).collect()}
    for i, x, y in pts:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in pts if j != i)[:3]
        assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in near]


def test_delaunay_edges_have_empty_circles():
    rng = np.random.default_rng(2)
    p = rng.random((60, 2))
    edges = set(map(tuple, graph.delaunay(p).tolist()))
    # an edge is in the triangulation if some circle through its ends holds no other point; the smallest one is enough to be in
    for i in range(60):
        for j in range(i + 1, 60):
            mid, r2 = (p[i] + p[j]) / 2, ((p[i] - p[j]) ** 2).sum() / 4
            inside = ((p - mid) ** 2).sum(axis=1) < r2 * (1 - 1e-9)
            inside[[i, j]] = False
            if not inside.any():
                assert (i, j) in edges
    assert len(edges) <= 3 * 60 - 6


def test_voc_ap_by_hand(spark):
    m = spark.createDataFrame([("c", 1, 0.9, True), ("c", 2, 0.8, False), ("c", 3, 0.7, True)], "class string, det long, score double, tp boolean")
    curve = evaluation.precision_recall(m, spark.createDataFrame([("c", 2)], "class string, npos long"))
    row = evaluation.average_precision(curve).first()
    assert round(row.ap, 5) == 0.83333 and round(row.ap11, 5) == 0.84848


def test_repeat_factor_by_hand(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "b"), (4, "b")], "image int, category string")
    got = {r.image: round(r.repeat_factor, 5) for r in sampling.repeat_factors(rows, "image", "category", 0.5).collect()}
    assert got == {1: 1.41421, 2: 1.0, 3: 1.0, 4: 1.0}


def test_numbering_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    rows = sampling.numbered(df, ["k"]).orderBy("k").collect()
    assert [r.number for r in rows] == list(range(1, 1001))


def test_cluster_gap_gets_a_name(spark):
    nodes = spark.createDataFrame([(1, 1, "x"), (2, 3, "y"), (3, 1, "z")], "id long, cluster_id int, cluster_name string")
    assert {r.cluster_id: r.cluster_name for r in graph.cluster_names(nodes).collect()} == {1: "z", 2: "Cluster 2", 3: "y"}


def test_nms_against_plain_version():
    rng = np.random.default_rng(3)
    for _ in range(20):
        b = rng.integers(0, 40, (60, 2))
        boxes = np.column_stack([b, b + rng.integers(5, 20, (60, 2))]).astype(float)
        scores, ids = rng.integers(0, 20, 60).astype(float), np.arange(60)
        stays, order = [], np.lexsort((ids, -scores))
        for i in order:
            if all(evaluation.iou_matrix(boxes[[i]], boxes[[j]])[0, 0] <= 0.3 for j in stays):
                stays.append(i)
        assert sorted(np.flatnonzero(matching.nms_kept(boxes, scores, ids, 0.3))) == sorted(stays)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(4)
    for n, m in ((3, 3), (2, 4), (4, 2), (1, 1)):
        for _ in range(20):
            cost = rng.integers(-9, 9, (n, m)).astype(float)
            r, c = matching.assignment(cost)
            small, big = (cost, m) if n <= m else (cost.T, n)
            best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(big), len(small)))
            assert len(r) == min(n, m) and len(set(c)) == len(c) and math.isclose(cost[r, c].sum(), best)


def test_rotated_iou():
    a = np.array([[5, 5, 4, 2, 0.0], [5, 5, 4, 2, 90.0], [5, 5, 4, 2, 180.0]])
    m = matching.rotated_iou(a, a)
    assert np.allclose(np.diag(m), 1) and math.isclose(m[0, 1], 4 / 12) and math.isclose(m[0, 2], 1.0)


def test_raster_kernels():
    m = np.zeros((9, 9), bool)
    m[2:7, 2:7] = True
    assert raster.erode(m, 1).sum() == 9 and raster.dilate(m, 1).sum() == 25 + 20
    hole = m.copy()
    hole[4, 4] = False
    assert raster.fill_holes(hole).sum() == 25
    assert raster.parts(np.eye(4, dtype=bool)).max() == 4 and raster.parts(np.eye(4, dtype=bool), True).max() == 1
    p = raster.simplify(raster.outline(m), 0.005)
    assert sorted(map(tuple, p.tolist())) == [(2, 2), (2, 6), (6, 2), (6, 6)]
    assert raster.distance_inside(m)[4, 4] == 3
    image = np.zeros((40, 40))
    yy, xx = np.mgrid[:40, :40]
    for cy, cx in ((10, 10), (28, 27)):
        image = np.maximum(image, 200 * np.exp(-((yy - cy) ** 2 + (xx - cx) ** 2) / 18))
    rng = np.random.default_rng(2)
    odd = rng.random((40, 33)) < 0.85
    ys, xs = np.nonzero(~odd)
    want = np.array([[np.sqrt(((ys - y) ** 2 + (xs - x) ** 2).min()) for x in range(33)] for y in range(40)])
    assert np.allclose(raster.distance_inside(odd), want)
    flat = np.array([[1, 1, 0, 3], [1, 2, 0, 3], [0, 0, 0, 0], [5, 5, 4, 0]], float)
    assert np.array_equal(raster.regional_maxima(flat), (flat == 3) | (flat == 5) | (flat == 2))
    labels = raster.threshold_segment(image, 60, sigma=1.0, area=(10, 1000))
    assert labels.max() == 2 and labels[10, 10] and labels[28, 27] and labels[10, 10] != labels[28, 27]


def test_expand_labels_against_kernel(spark):
    rng = np.random.default_rng(5)
    a = np.zeros((20, 20), np.int64)
    a[rng.integers(3, 17, 6), rng.integers(3, 17, 6)] = np.arange(1, 7)
    rows = [(int(y), int(x), int(a[y, x])) for y, x in np.argwhere(a)]
    got = {(r.y, r.x): r.label for r in raster.expand_labels(spark.createDataFrame(rows, "y int, x int, label long"), 3).collect()}
    want, _ = raster.nearest(a, 3)
    assert all(got[y, x] == want[y, x] for y, x in np.argwhere(want).tolist())


def test_batch_and_stepwise_tracks_agree():
    rng = np.random.default_rng(6)
    o = tracking.TrackOptions("hungarian", 0.3, 2)
    state, next_id, seen = [], 0, []
    base = np.array([[0, 0, 10, 10], [50, 50, 60, 60.0]])
    for k in range(6):
        boxes = base + k + rng.random((2, 1))
        now, kept, next_id = tracking.step(state, boxes if k != 3 else boxes[:1], next_id, o)
        state = now + kept
        seen.append([t["id"] for t in now])
    assert seen == [[0, 1], [0, 1], [0, 1], [0], [0, 1], [0, 1]]


def test_panoptic_fusion_drops_covered_instances(spark):
    px = [(1, 0, x, 1, 5, 0.9) for x in range(6)] + [(1, 0, x, 2, 5, 0.8) for x in range(5)] + [(1, 0, x, None, 7, 1.0) for x in range(10)]
    df = spark.createDataFrame(px, "image long, y int, x int, instance int, class int, score double")
    got = {r.x: (r.segment, r["class"]) for r in matching.panoptic_fusion(df, 0.5, 4).collect()}
    assert got == {x: ((1, 5) if x < 6 else (2, 7)) for x in range(10)}


def test_work_log(spark, tmp_path):
    log = incremental.WorkLog(spark, str(tmp_path / "log"), {"a": 1, "threshold_algorithm": "x"})
    units = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "unit string")
    log.append(units.where("unit = 'u1'"), "running")
    log.append(units.where("unit = 'u2'"), "running")
    log.append(units.where("unit = 'u2'"), "failed", "bad")
    assert sorted(r.unit for r in log.todo(units).collect()) == ["u1", "u3"]
    assert sorted(r.unit for r in log.todo(units, True).collect()) == ["u1", "u2", "u3"]
    incremental.WorkLog(spark, str(tmp_path / "log"), {"a": 1, "threshold_algorithm": "y"})
    with pytest.raises(ValueError):
        incremental.WorkLog(spark, str(tmp_path / "log"), {"a": 2})


def test_work_counts_once_whatever_breaks(spark, tmp_path, monkeypatch):
    log = incremental.WorkLog(spark, str(tmp_path / "log"), {"a": 1})
    units = spark.createDataFrame([("u1",), ("u2",)], "unit string")
    work = lambda left: left.selectExpr("unit", "1 as n")
    create = incremental.WorkLog._create
    # results are written, then the run breaks before it is completed
    monkeypatch.setattr(incremental.WorkLog, "_write", lambda self, u, state, *a, f=incremental.WorkLog._write: f(self, u, state, *a) if state != "completed" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        log.run(units, work)
    monkeypatch.undo()
    # both are written, but not their marker
    made = []
    monkeypatch.setattr(incremental.WorkLog, "_create", lambda self, name: made.append(name) or (1 / 0 if len(made) == 3 else create(self, name)))
    with pytest.raises(ZeroDivisionError):
        log.run(units, work)
    monkeypatch.undo()
    assert log.results() is None and {r.state for r in log.states().collect()} == {"running"}
    assert sorted(tuple(r) for r in log.run(units, work).collect()) == [("u1", 1), ("u2", 1)]
    more = units.unionAll(spark.createDataFrame([("u3",)], "unit string"))
    assert sorted(r.unit for r in log.run(more, work).collect()) == ["u1", "u2", "u3"] and log.run(more, work).count() == 3
    assert {(r.state, r.attempt) for r in log.states().where("unit <> 'u3'").collect()} == {("completed", 3)}


def test_one_run_holds_the_lock(spark, tmp_path):
    log = incremental.WorkLog(spark, str(tmp_path / "log"), {"a": 1})
    units = spark.createDataFrame([("u1",)], "unit string")

    def other(left):
        with pytest.raises(RuntimeError):
            log.run(units, lambda x: x)
        return left

    assert log.run(units, other).count() == 1 and log.run(units, other).count() == 1


def test_batches_tell_and_can_be_stopped(spark, tmp_path):
    log = incremental.WorkLog(spark, str(tmp_path / "log"), {"a": 1})
    units = spark.range(20).selectExpr("concat('u', id) as unit")
    told: list = []
    log.run_in_batches(units, lambda left: left, 5, lambda *a: told.append(a), lambda: len(told) >= 2)
    done = told[-1][1]
    assert len(told) == 2 and 0 < done < 20 and log.results().count() == done
    assert log.run_in_batches(units, lambda left: left, 50, lambda *a: told.append(a)).count() == 20 and told[-1] == ("completed", 20, 20)


def test_ratio_sample(spark):
    df = spark.range(101)
    a, b = (sorted(r.id for r in sampling.ratio_sample(d, "id", 0.25).collect()) for d in (df, df.repartition(7)))
    assert a == b and len(a) == 25


def test_phases_retry_what_failed(spark, tmp_path):
    log = incremental.WorkLog(spark, str(tmp_path / "log"), {"a": 1})
    units = spark.createDataFrame([("u1",), ("u2",)], "unit string")
    log.append(units.where("unit = 'u2'"), "failed", "once")
    assert sorted(r.unit for r in log.phases(units, lambda left: left).collect()) == ["u1", "u2"]


def test_painting_by_runs_is_painting_by_pixels(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(y), int(x), int(x) + int(w)) for i in range(60) for y, x, w in zip(rng.integers(-20, 200, 4), rng.integers(-30, 300, 4), rng.integers(0, 90, 4), strict=True)]
    scores = [(i, float(i % 7)) for i in range(60)]
    runs = spark.createDataFrame(rows, "id long, y long, x0 long, x1 long").distinct()
    want: dict = {}
    for i, y, a, b in {tuple(r) for r in runs.collect()}:
        for x in range(a, b):
            want.setdefault((y, x), []).append((-(i % 7), i))
    got = masks.to_pixels(masks.paint_runs(runs, spark.createDataFrame(scores, "id long, score double"), 64, 100)).collect()
    assert {(r.y, r.x): (r.label, r.n) for r in got} == {k: (min(v)[1], len(v)) for k, v in want.items()} and len(got) == len(want)


def test_cross_overlaps_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    box = lambda n: [(int(i), int(i % 2), *map(float, p), *map(float, p + rng.integers(1, 80, 2))) for i, p in enumerate(rng.integers(-50, 300, (n, 2)))]
    a, b = box(60), box(70)
    got = joins.cross_overlaps(*[spark.createDataFrame(x, "id int, c int, x0 double, y0 double, x1 double, y1 double") for x in (a, b)], 40.0, ("c",))
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5])
    assert sorted((r.id_a, r.id_b) for r in got.collect()) == want


def test_communities_of_two_cliques():
    edges = [(a, b, 1.0) for g in (range(5), range(5, 10)) for a in g for b in g if a < b] + [(0, 5, 0.1)]
    got = phenotype.communities(edges, list(range(10)))
    assert [got[i] for i in range(10)] == [0] * 5 + [1] * 5


def test_scalars(spark):
    df = spark.createDataFrame([(1.5, "  a \n b "), (float("nan"), ""), (None, None)], "x double, s string")
    rows = df.select(scalar.impute("x", 7.0).alias("i"), scalar.clip("x", 0.0, 1.0).alias("c"), scalar.clean_label("s").alias("l")).collect()
    assert [r.i for r in rows] == [1.5, 7.0, 7.0] and [r.l for r in rows] == ["a b", "channel", "channel"]
    assert rows[2].c is None
    b = geometry.Box(*[F.lit(v) for v in (0.0, 0.0, 2.0, 2.0)])
    assert spark.range(1).select(geometry.iou(b, b.shift(1.0, 0.0)).alias("v")).first().v == pytest.approx(1 / 3)


def test_wide_nms_is_nms(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), int(i % 2), float(rng.integers(0, 30)), *map(int, p), *map(int, p + rng.integers(5, 25, 2))) for i, p in enumerate(rng.integers(0, 120, (150, 2)))]
    df = spark.createDataFrame(rows, "id long, class_id int, score double, x0 long, y0 long, x1 long, y1 long")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(matching.wide_nms(df, 0.2, ["class_id"], 16)) == ids(matching.nms(df, 0.2, ["class_id"]))


def test_tracks_don_t_depend_on_batches(spark):
    rng = np.random.default_rng(9)
    rows = [(v, f, d, float(x), float(f), float(x + 20), float(f + 20)) for v in range(3) for f in range(40) for d, x in enumerate((0, 100 + rng.integers(0, 3)))]
    df = spark.createDataFrame(rows, "video long, frame long, det long, x0 double, y0 double, x1 double, y1 double")
    key = lambda d: sorted(map(tuple, d.collect()))
    once = key(tracking.track(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert key(tracking.track(df)) == once
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r[3] for r in once} == {0, 1}


def test_instances_and_rendering(spark):
    from tesserae.operators import instances, render

    masks_ = spark.createDataFrame([(1, 2, [1.0, 0.0, 1.0, 0.0], 0.0, 0.0, 4.0, 4.0)], "id int, size int, values array<double>, x0 double, y0 double, x1 double, y1 double")
    got = {(r.y, r.x) for r in render.paste(masks_).collect()}
    assert {(1, 0), (2, 0), (1, 1), (2, 1)} <= got <= {(y, x) for y in range(4) for x in (0, 1)}
    df = spark.createDataFrame([(1, 0, 0, 5.0, 5.0), (2, 3, 3, 3.0, 9.0)], "id int, x0 int, y0 int, x1 double, y1 double")
    assert [r.id for r in instances.nonempty(df).collect()] == [1]
    x, y = render.rotate(F.lit(0.0), F.lit(0.0), 90, 10, 20)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (round(r.x, 6), round(r.y, 6)) == (0.0, 10.0)
    assert render.best_level(spark.createDataFrame([(0, 1.0), (1, 4.0), (2, 16.0)], "level int, scale double"), 2.0).first().level == 0


def test_inference_through_an_adapter(spark):
    from tesserae.operators import inference

    image = np.zeros((60, 60))
    yy, xx = np.mgrid[:60, :60]
    for cy, cx in ((15, 15), (40, 42)):
        image = np.maximum(image, 200 * np.exp(-((yy - cy) ** 2 + (xx - cx) ** 2) / 18))
    options = tiling.TileOptions(40, overlap_px=20)
    grid = tiling.tile_grid(tiling.one_image(spark, 60, 60), options).collect()
    tiles = [(t.tile_id, t.x0, t.y0, t.cx0, t.cy0, t.cx1, t.cy1, t.y1 - t.y0, t.x1 - t.x0, image[t.y0 : t.y1, t.x0 : t.x1].ravel().tolist()) for t in grid]
    df = spark.createDataFrame(tiles, "tile_id string, x0 long, y0 long, cx0 long, cy0 long, cx1 long, cy1 long, height int, width int, values array<double>")
    found = inference.predict(df, lambda: inference.ThresholdAdapter(60, {"area": (10, 1000)}), batch=2)
    owned = sorted((round(r.centroid_x), round(r.centroid_y)) for r in found.where("owned").collect())
    assert owned == [(15, 15), (42, 40)] and found.count() >= 2
    runs = masks.unpack(found.select(F.monotonically_increasing_id().alias("id"), F.col("x0").cast("int").alias("x"), F.col("y0").cast("int").alias("y"), "width", "height", "data"))
    assert masks.statistics(runs).agg(F.sum("area")).first()[0] == found.agg(F.sum("area")).first()[0]


def test_augmented_views_are_suppressed_together(spark):
    from tesserae.operators import inference

    one = spark.createDataFrame([(1, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0)], "id long, image int, class_id int, score double, x0 double, y0 double, x1 double, y1 double")
    two = spark.createDataFrame([(1, 1, 0, 0.8, 1.0, 0.0, 11.0, 10.0), (2, 1, 0, 0.7, 50.0, 50.0, 60.0, 60.0)], one.schema)
    assert sorted(r.score for r in inference.augmented([one, two], 0.5, 10).collect()) == [0.7, 0.9]
