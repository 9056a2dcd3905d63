"""What grows with the input stays off the driver, and dense tables are worked out by their places."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tesserae import session
from tesserae.llm.common import join_hot
from tesserae.operators import evaluation, graph, joins, masks, matching, reconcile, runs
from tesserae.operators.components import connected_components
from tesserae.operators.sampling import numbered
from tesserae.plans.catalogue import QUERIES
from tesserae.sources import annotations, sinks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_side_is_not_broadcast(spark):
    left = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("v"))
    out = join_hot(left, spark.range(0, 100, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")), ["k"], salt_by=["v"], small=False)
    assert "BroadcastExchange" not in plan(out)
    assert {(r.k, r.w) for r in out.collect()} == {(k, 2 * k if k % 2 == 0 else None) for k in range(100)}


def test_a_side_of_many_rows_is_dealt(spark, monkeypatch):
    left, right = spark.range(100), spark.range(0, 100, 2).withColumn("w", F.col("id") * 2)
    assert "BroadcastExchange" in plan(left.join(session.small(right), "id"))
    monkeypatch.setattr(session, "at_most", lambda df, rows=0: False)
    assert "BroadcastExchange" not in plan(left.join(session.small(right), "id"))


def crowded(spark):
    """Many cells on few places, and what lies within 2 of what, worked out plainly."""
    draw = random.Random(5)
    rows = [(i, float(draw.randrange(6)), draw.randrange(6) / 2, draw.randrange(4)) for i in range(150)]
    edges = {(a[0], b[0]): (a, b) for a in rows for b in rows if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 4}
    return spark.createDataFrame(rows, "id long, x double, y double, cluster_id int"), edges


def test_radius_graph_of_crowded_places(spark):
    cells, edges = crowded(spark)
    out = graph.radius_graph(cells, 2, carry=("cluster_id",))
    assert "BroadcastExchange" not in plan(out) and "BroadcastHashJoin" not in plan(joins.radius_pairs(cells, 2))
    got = [(r.source, r.target, r.cluster_id_s, r.cluster_id_t) for r in out.collect()]
    assert sorted(got) == sorted((*k, a[3], b[3]) for k, (a, b) in edges.items())


def test_degrees_without_edges(spark):
    cells, edges = crowded(spark)
    out = graph.radius_degrees(cells, 2)
    assert "BroadcastExchange" not in plan(out)
    assert {r.id: r.degree for r in out.collect()} == {i: n for i in range(150) if (n := sum(i in e for e in edges))}


def test_interactions_without_edges(spark):
    cells, edges = crowded(spark)
    out = graph.interaction_counts(graph.radius_interactions(cells, 2), cells.select("cluster_id").where("cluster_id > 0").distinct())
    pairs = [tuple(sorted((a[3], b[3]))) for a, b in edges.values()]
    assert {(r.a, r.b): r.observed for r in out.collect()} == {(a, b): pairs.count((a, b)) for a in (1, 2, 3) for b in (1, 2, 3) if a <= b}


def test_export_and_viewport_know_clusters_before_edges(spark):
    cells, edges = crowded(spark)
    known = cells.where("cluster_id > 1").withColumn("cluster_name", F.concat(F.lit("C"), F.col("cluster_id").cast("string")))
    out = graph.export_radius(cells, 2, known, "id", 0.5)
    name = lambda c: f"C{c}" if c > 1 else "Unassigned"
    assert "BroadcastExchange" not in plan(out)
    assert sorted((r.source, r.target, r.cluster_id_s, r.cluster_name_t) for r in out.collect()) == sorted((*k, a[3] if a[3] > 1 else 0, name(b[3])) for k, (a, b) in edges.items())
    found, more = graph.viewport(graph.radius_graph(cells, 2, carry=("x", "y", "cluster_id")), 0, 0, 1, 1, 7, graph.pair_filter("pair", 1, 2))
    want = sorted(k for k, (a, b) in edges.items() if {a[3], b[3]} == {1, 2} and min(a[1], b[1]) <= 1 and min(a[2], b[2]) <= 1)
    assert more and [(r.source, r.target) for r in found.collect()] == want[:7]


def test_neighbours_of_crowded_places(spark, monkeypatch):
    cells, _ = crowded(spark)
    rows = cells.collect()
    out = joins.knn(cells, 3, 8.0)
    want = {r.id: [b for _, b in sorted(((r.x - o.x) ** 2 + (r.y - o.y) ** 2, o.id) for o in rows if o.id != r.id)[:3]] for r in rows}
    got = {}
    for r in out.orderBy("a", "rank").collect():
        got.setdefault(r.a, []).append(r.b)
    assert got == want and plan(out).count("Window") == 0  # lists of a place, not rows of each of its cells


def sides(spark):
    draw = random.Random(7)
    box = lambda: (x := draw.randrange(300), y := draw.randrange(300), x + draw.randrange(20, 90), y + draw.randrange(20, 90))
    made = lambda lo: [(lo + i, i % 2, *box()) for i in range(40)]
    names = "id long, image int, x0 int, y0 int, x1 int, y1 int"
    far = (900, 0, 5000, 5000, 5010, 5010)
    pred, gt = [*made(100), far, (901, 7, 0, 0, 9, 9)], made(0)
    iou = {}
    for p in pred:
        for g in gt:
            if p[1] == g[1]:
                n = max(0, min(p[4], g[4]) - max(p[2], g[2])) * max(0, min(p[5], g[5]) - max(p[3], g[3]))
                iou[p[0], g[0]] = n / ((p[4] - p[2]) * (p[5] - p[3]) + (g[4] - g[2]) * (g[5] - g[3]) - n)
    return spark.createDataFrame(pred, names), spark.createDataFrame(gt, names), iou


def test_match_labels_by_buckets(spark):
    pred, gt, iou = sides(spark)
    out = joins.match_labels(gt, pred, 0.2, 0.4)
    assert "_gx" in plan(out)  # not all pairs of an image
    got = {r.pred: (r.gt, r.iou) for r in out.collect()}
    assert got.pop(901) == (None, 0.0) and got[900] == (0, 0.0)
    best = {}
    for (p, g), v in iou.items():
        best[p] = max(best.get(p, (-1.0, 0)), (v, -g))
    assert got == {p: (-g, v) for p, (v, g) in best.items()}


def test_greedy_pairs_by_buckets(spark):
    pred, gt, iou = sides(spark)
    out = matching.greedy_one_to_one(pred, gt)
    assert "FlatMapGroupsInPandas" not in plan(out)  # no image's whole matrix
    want, used = {}, set()
    for (p, g), v in sorted(iou.items(), key=lambda x: (-x[1], x[0])):
        if v > 0 and not {("p", p), ("g", g)} & used:
            used |= {("p", p), ("g", g)}
            want[p, g] = v
    assert {(r.pred, r.gt): r.iou for r in out.collect()} == want
    recall = evaluation.proposal_recall(gt, pred.withColumn("score", F.lit(1.0)), 1000, steps=(0.3, 0.5))
    assert "FlatMapGroupsInPandas" not in plan(recall)
    row = recall.first()
    assert row.num_pos == 40 and abs(row.ar - sum(sum(v >= t for v in want.values()) / 40 for t in (0.3, 0.5)) / 2) < 1e-12


def test_masks_are_not_broadcast(spark):
    runs = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 0, 4), (2, 1, 2, 6), (3, 9, 0, 1)], "id long, y long, x0 long, x1 long")
    out = masks.overlaps(runs, spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"))
    assert "BroadcastExchange" not in plan(out)
    assert {(r.a, r.b): (r.intersection, round(r.iou, 6)) for r in out.collect()} == {(1, 2): (2, 0.2), (1, 3): (0, 0.0)}


def test_archives_are_not_broadcast(spark, sf_dir):
    assert "BroadcastExchange" not in plan(QUERIES["archive_round_trip"](spark, sf_dir))


def test_coco_documents_in_parts(spark, tmp_path):
    notes = spark.range(95).select("id", (F.col("id") % 2).alias("image_id"), (F.col("id") % 3 * 10).alias("category_id"), F.array(F.array(*[F.lit(float(k)) for k in (0, 0, 1, 0, 1, 1)])).alias("segmentation"))
    pictures = spark.range(2).select("id", F.format_string("i%d.jpg", "id").alias("file_name"))
    kinds = spark.range(3).select((F.col("id") * 10).alias("id"), F.lit('a "b"').alias("name"))
    sinks.coco_documents(pictures, kinds, notes, str(tmp_path / "d"), rows=10)
    docs = [json.loads(p.read_text()) for p in (tmp_path / "d").glob("part-*")]
    assert len(docs) == 12 and all(set(d) == {"images", "categories", "annotations"} and 0 < sum(map(len, d.values())) <= 30 for d in docs)
    images, categories, rows = annotations.read_coco(spark, str(tmp_path / "d"))
    assert images.count() == 2 and {r.name for r in categories.collect()} == {'a "b"'}
    assert sorted((r.id, r.image_id, r["class"], len(r.polygons)) for r in rows.collect()) == [(i, i % 2, i % 3, 1) for i in range(95)]


def test_coco_scan_has_no_document_of_all_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(sinks, "coco_document", None)
    assert QUERIES["coco_scan"](spark, sf_dir).count() == 160


def test_viewer_index_by_places(spark, tmp_path):
    cells, edges = crowded(spark)
    folder = str(tmp_path / "v")
    assert runs.viewer_index_radius(cells, 2, folder, 1.0) and not runs.viewer_index_radius(cells, 2, folder, 1.0)
    assert spark.read.parquet(f"{folder}/edges").select("first_a", "first_b").distinct().count() < len(edges) / 2  # places, not edges
    seen, lines = runs.viewport(spark, folder, 1, 0.5, 3, 1)
    assert seen.count() == sum(1 <= r.x <= 3 and 0.5 <= r.y <= 1 for r in cells.collect())
    meets = lambda a, b: min(a[1], b[1]) <= 3 and max(a[1], b[1]) >= 1 and min(a[2], b[2]) <= 1 and max(a[2], b[2]) >= 0.5
    got = [(r.source, r.target, r.x_s, r.y_t, r.cluster_id_s, r.cluster_id_t) for r in lines.collect()]
    assert sorted(got) == sorted((*k, a[1], b[2], a[3], b[3]) for k, (a, b) in edges.items() if meets(a, b))
    assert runs.viewer_index_radius(cells, 1, folder, 1.0)


def test_viewer_edges_writes_no_edges(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(runs, "spatial", None)
    assert QUERIES["viewer_edges"](spark, sf_dir).count() >= 0


def tiles(spark, n=160, seed=9):
    """Boxes of several tiles, some of which lie over borders of buckets and some on equal places."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = draw.randrange(90), draw.randrange(90), draw.randrange(1, 30), draw.randrange(1, 30)
        rows.append((i, draw.randrange(3), draw.randrange(2), float(draw.randrange(9)), w * h, x, y, x + w, y + h))
    names = "id long, tile int, class_id int, score double, area long, x0 long, y0 long, x1 long, y1 long"
    linked = {}
    for a in rows:
        for b in rows:
            w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
            if a[0] < b[0] and a[1] != b[1] and a[2] == b[2] and w > 0 and h > 0:
                one, two = w * h / (a[4] + b[4] - w * h), w * h / min(a[4], b[4])
                if one >= 0.2 or two >= 0.5:
                    linked[a[0], b[0]] = (w * h, round(one + 1e-9, 6), round(two + 1e-9, 6))
    return spark.createDataFrame(rows, names), linked


OPTIONS = reconcile.ReconcileOptions(0.2, 0.5, bucket=16)


def test_links_by_cells(spark):
    boxes, linked = tiles(spark)
    out = reconcile.links(boxes, OPTIONS, places=6)
    assert "Join" not in plan(out)  # pairs are made as matrices of a cell, not as rows
    assert {(r.a, r.b): (r.intersection, r.iou, r.containment) for r in out.collect()} == linked and out.count() == len(linked)
    odd = boxes.selectExpr("concat('k', id) as id", "nullif(tile, 7) as tile", "class_id", "area", "x0 + 0.5D as x0", "y0 + 0.5D as y0", "x1 + 0.5D as x1", "y1 + 0.5D as y1")
    odd = odd.unionAll(odd.limit(3).selectExpr("id", "null", "class_id", "area", "x0", "y0", "x1", "y1")).unionAll(odd.limit(3).selectExpr("'none'", "tile + 9", "class_id", "null", "null", "y0", "x1", "y1"))
    found = {tuple(sorted((int(r.a[1:]), int(r.b[1:])))): r.intersection for r in reconcile.links(odd, OPTIONS).collect()}
    assert found == {k: float(v[0]) for k, v in linked.items()} and reconcile.links(boxes.limit(0), OPTIONS).count() == 0


def reached(nodes, linked):
    """Each node's smallest node that links lead to."""
    up = {i: i for i in nodes}
    for _ in nodes:
        for a, b in linked:
            up[a] = up[b] = min(up[a], up[b])
    return up


def test_ties_have_the_groups_of_links(spark):
    for seed in (9, 10):
        boxes, linked = tiles(spark, 260, seed)
        out = reconcile.ties(boxes, OPTIONS)
        up = reached(range(260), linked)
        assert "Join" not in plan(out)
        assert {r.node: r.component for r in connected_components(out, "a", "b").collect()} == {i: up[i] for e in linked for i in e}
    nowhere = boxes.limit(1).selectExpr("id + 999 as id", "tile", "class_id", "area", "x0", "y0", "x1", "double('nan') as y1")
    odd = reconcile.ties(boxes.select(nowhere.columns).unionAll(nowhere), OPTIONS)
    assert {r.node: r.component for r in connected_components(odd, "a", "b").collect()} == {i: up[i] for e in linked for i in e}
    # as many as boxes of cells at most, though all are linked with all
    same = spark.range(200).selectExpr("id", "id as tile", "0 as class_id", "100L as area", "0L as x0", "0L as y0", "10L as x1", "10L as y1")
    assert reconcile.ties(same, OPTIONS).count() == 199 and reconcile.links(same, OPTIONS).count() == 19900


def test_components_use_ties(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(reconcile, "links", None)
    assert QUERIES["connected_components"](spark, sf_dir).count() >= 0


def members(spark):
    boxes, linked = tiles(spark)
    rows = boxes.selectExpr("*", "tile < 2 as owned", "x0 % 10 = 0 as at_edge", "(x0 + x1) / 2 as centroid_x", "(y0 + y1) / 2 as centroid_y")
    return reconcile.groups(rows, reconcile.ties(rows, OPTIONS)), reached(range(160), linked)


def test_global_cells_are_not_broadcast(spark, monkeypatch):
    grouped, up = members(spark)
    assert "BroadcastExchange" not in plan(grouped) and {r.id: r.root for r in grouped.collect()} == up
    seen = []
    monkeypatch.setattr(reconcile, "numbered", lambda df, *more: seen.append(plan(df)) or numbered(df, *more))
    cells = reconcile.global_cells(grouped)
    assert "BroadcastExchange" not in seen[0]
    assert {r.first_member: r.source_count for r in cells.collect()} == {k: list(up.values()).count(k) for k in set(up.values())}


def test_global_ids_use_ties(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(reconcile, "links", None)
    assert QUERIES["global_ids"](spark, sf_dir).count() >= 0


def test_sources_of_a_large_group(spark, sf_dir, monkeypatch):
    grouped, up = members(spark)
    cells = reconcile.global_cells(grouped)
    assert {(r.prediction_id, r.is_representative) for r in reconcile.cell_sources(grouped, cells).collect()} == {(i, i in {c.representative for c in cells.collect()}) for i in up}
    monkeypatch.setattr(session, "at_most", lambda df, rows=0: False)
    assert plan(reconcile.cell_sources(grouped, cells)).count("BroadcastHashJoin") == 1  # where partitions' numbers begin
    monkeypatch.setattr(reconcile, "links", None)
    assert QUERIES["cell_sources"](spark, sf_dir).count() >= 0


def test_wide_nms_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(matching, "ONE_TASK", 0)  # to the end by cells
    for seed, bucket in ((1, 4), (2, 8), (3, 64)):
        draw = random.Random(seed)
        rows = [(f"k{i}", i % 2, draw.choice([0.5, 1.0, 2.5, None, float("nan")]) if i % 9 else float(i), *(p := (draw.randrange(60), draw.randrange(60))), p[0] + draw.randrange(1, 50), p[1] + draw.randrange(1, 12)) for i in range(220)]
        names = "id string, class_id int, score double, x0 int, y0 int, x1 int, y1 int"
        boxes = spark.createDataFrame(rows, names)
        got = matching.wide_nms(boxes.unionAll(spark.createDataFrame([("n", None, 9.0, 0, 0, 60, 60), ("m", 1, 9.0, None, 0, 60, 60)], names)), 0.1, ["class_id"], bucket)
        assert sorted(r.id for r in got.collect()) == sorted(["m", "n", *[r.id for r in matching.nms(boxes.na.fill(-1.0), 0.1, ["class_id"]).collect()]])
        assert got.schema == boxes.schema


def test_wide_nms_has_no_task_of_all(spark, monkeypatch):
    """A chain in which each box hangs on the one before it, over many cells."""
    groups = []
    monkeypatch.setattr(matching, "ONE_TASK", 30)
    monkeypatch.setattr(matching, "nms", lambda df, *more, f=matching.nms: groups.append(df.count()) or f(df, *more))
    boxes = spark.range(400).selectExpr("id", "0 as class_id", "double(-id) as score", "id * 5 as x0", "0L as y0", "id * 5 + 9 as x1", "9L as y1")
    assert sorted(r.id for r in matching.wide_nms(boxes, 0.2, ["class_id"], 8).collect()) == list(range(0, 400, 2)) and max(groups) <= 30


def test_union_is_not_broadcast(spark, sf_dir):
    draw = random.Random(4)
    runs = [(i, draw.randrange(3), x := draw.randrange(30), x + draw.randrange(1, 9)) for i in range(120)]
    pixels = {(i % 2, y, x) for i, y, lo, hi in runs for x in range(lo, hi)}
    df = spark.createDataFrame(runs, "id long, y long, x0 long, x1 long")
    for out in (masks.union(df, spark.range(120).selectExpr("id", "id % 2 as group")), masks.union(df.selectExpr("id % 2 as group", "y", "x0", "x1"))):
        assert "BroadcastExchange" not in plan(out)
        rows = out.collect()
        assert {(r.id, r.y, x) for r in rows for x in range(r.x0, r.x1)} == pixels and sum(r.x1 - r.x0 for r in rows) == len(pixels)
    assert "BroadcastExchange" not in plan(QUERIES["mask_union"](spark, sf_dir))


def test_masks_are_packed_in_place(spark, monkeypatch):
    """As runs say, by the pixel; a few bits at a time; masks of no pixel are left out."""
    draw = random.Random(8)
    lists = {f"m{i}": [(y, x := draw.randrange(5) + k * 20, x + draw.randrange(18)) for y in range(draw.randrange(-3, 3), 6) if draw.random() < 0.8 for k in range(2)] for i in range(40)} | {"none": [], "null": None}
    pixels = {i: {(y, x) for y, lo, hi in v or () for x in range(lo, hi)} for i, v in lists.items()}
    df = spark.createDataFrame(list(lists.items()), "id string, mask array<struct<y: long, x0: long, x1: long>>")
    for bits in (1 << 22, 100):
        monkeypatch.setattr(masks, "BITS", bits)
        out = masks.packed(df)
        assert "Exchange" not in plan(out)
        back = masks.unpack(out.select("id", F.col("x0").cast("int").alias("x"), F.col("y0").cast("int").alias("y"), "width", "height", "data"))
        got = {}
        for row in back.collect():
            got.setdefault(row.id, set()).update((row.y, x) for x in range(row.x0, row.x1))
        assert got == {i: p for i, p in pixels.items() if p}
        want = masks.statistics(df.select("id", F.explode("mask").alias("m")).select("id", "m.*").where("x1 > x0")).collect()
        assert sorted(tuple(row) for row in want) == sorted(tuple(row) for row in out.select("id", "area", "x0", "y0", "x1", "y1", "centroid_x", "centroid_y").collect())
    wide = out.select("id", (F.col("x0") - 1).alias("x"), (F.col("y0") + 5).alias("y"), "width", "height", "data")
    assert {r.id: (r.area, r.x0, r.y0) for r in masks.measured(wide).collect()} == {i: (len(p), min(x for _, x in p) - 1, min(y for y, _ in p) + 5) for i, p in pixels.items() if p}
    corner = spark.createDataFrame([(1, 10, 20, 3, 2, bytearray(b"\x30")), (2, 0, 0, 3, 2, bytearray(b"\x00"))], "id int, x int, y int, width int, height int, data binary")
    assert [tuple(r) for r in masks.measured(corner).collect()] == [(1, 2, 11, 21)]
    with pytest.raises(Exception, match="reshape"):  # too few bits
        masks.measured(corner.withColumn("width", F.lit(5))).collect()


def test_archives_are_read_by_name(spark, sf_dir, tmp_path, monkeypatch):
    """Masks travel once, to their tile's task; files aren't listed by the driver, and no runs are made of what they hold."""
    for name in ("unpack", "statistics"):
        monkeypatch.setattr(masks, name, None)
    out = QUERIES["archive_round_trip"](spark, sf_dir)
    text = plan(out)
    assert "Join" not in text and "binaryFile" not in text.lower() and out.count() == 200


def test_masks_meet_where_pairs_are_made(spark, monkeypatch):
    """The pairs of boxes with their masks' figures, in one matrix or in bands, of one run a row or of several, without a join of runs."""
    from tesserae.operators import cells

    boxes, linked = tiles(spark)
    plain = [(b.id, y, b.x0 + b.id % 2, b.x1) for b in boxes.collect() for y in range(b.y0, b.y1) if b.id % 40]
    holes = [(i, y, *part) for i, y, lo, hi in plain for part in ((lo, (lo + hi) // 2), ((lo + hi) // 2 + y % 2, hi)) if i % 3 or part[0] == lo]
    for rows, dense, band in ((plain, 1 << 22, 128), (plain, 1, 128), (holes, 1 << 22, 128), (holes, 1, 4)):
        monkeypatch.setattr(cells, "DENSE", dense)
        monkeypatch.setattr(cells, "BAND", band)
        runs = spark.createDataFrame(rows, "id long, y long, x0 long, x1 long")
        pixels, area = {}, {}
        for i, y, lo, hi in rows:
            pixels.setdefault(i, set()).update((y, x) for x in range(lo, hi))
        area = {i: len(p) for i, p in pixels.items()}
        want = {}
        for a, b in linked:
            if a in area and b in area:
                n = len(pixels[a] & pixels[b])
                want[a, b] = (n, n / max(1, area[a] + area[b] - n), n / max(1, min(area[a], area[b])))
        out = reconcile.overlaps(boxes.join(masks.lists(runs), "id"), OPTIONS, places=6)
        assert {(r.a, r.b): (r.intersection, r.iou, r.containment) for r in out.collect()} == {k: (n, round(u + 1e-9, 6), round(c + 1e-9, 6)) for k, (n, u, c) in want.items()} and want
        by_masks = reconcile.links(boxes.drop("area").join(masks.statistics(runs).select("id", "area"), "id"), OPTIONS, runs)
        assert {(r.a, r.b): r.intersection for r in by_masks.collect()}.items() >= {k: n for k, (n, u, c) in want.items() if u >= 0.2 or c >= 0.5}.items()
        assert [r for r in by_masks.collect() if r.iou < 0.2 and r.containment < 0.5] == []


def test_mask_overlaps_joins_no_runs(spark, sf_dir):
    out = QUERIES["mask_overlaps"](spark, sf_dir)
    assert "Join" not in plan(out) and [t for _, t in out.dtypes] == ["bigint", "bigint", "bigint", "double"]
