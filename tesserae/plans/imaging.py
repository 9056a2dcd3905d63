"""Instances, rendering, rasters and further kernels over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.functions import geometry
from tesserae.functions.geometry import Box
from tesserae.operators import graph, instances, joins, masks, matching, phenotype, raster, render
from tesserae.plans.registry import big, query, r, table
from tesserae.plans.spatial import BOXES, box_runs, boxes, label_pixels, points, suppressed
from tesserae.session import at_most, fresh_dir

#: Points that communities are fitted on at most, and neighbours of each.
SAMPLE, NEIGHBOURS = 100_000, 15

# a heat map of orders: prices on a grid of 100 columns
HEAT = "heat AS (SELECT o_custkey % 3 AS image, o_orderkey // 100 AS y, o_orderkey % 100 AS x, o_totalprice AS value FROM orders)"


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("image"), F.floor(F.col("o_orderkey") / 100).alias("y"), (F.col("o_orderkey") % 100).alias("x"), F.col("o_totalprice").alias("value"))


@query(f"""
    WITH {HEAT}, hot AS (SELECT * FROM heat WHERE value > 300000), k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY value DESC, y, x) AS rank FROM hot a
        WHERE NOT EXISTS (SELECT 1 FROM hot b WHERE b.image = a.image AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 AND b.value > a.value))
    SELECT image, y, x, rank FROM k WHERE rank <= 200
""")
def center_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances.centers(heat(spark, sf_dir), 300000, 2, 200).select("image", "y", "x", "rank")


@query(f"""
    WITH {HEAT}, c AS (SELECT * FROM (VALUES (0, 1, 20, 30), (0, 2, 90, 60), (1, 3, 50, 50), (2, 4, 10, 10), (2, 5, 100, 90), (2, 6, 60, 20)) t(image, id, cy, cx))
    SELECT image, y, x, arg_min(id, ((y - cy) * (y - cy) + (x - cx) * (x - cx), id)) AS center FROM heat JOIN c USING (image) GROUP BY ALL
""")
def pixel_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame([(0, 1, 20, 30), (0, 2, 90, 60), (1, 3, 50, 50), (2, 4, 10, 10), (2, 5, 100, 90), (2, 6, 60, 20)], "image long, id int, cy int, cx int")
    return instances.nearest_center(heat(spark, sf_dir).select("image", "y", "x"), c)


@query("""
    WITH p AS (SELECT l_orderkey % 50 AS image, l_orderkey * 10 + l_linenumber AS id, l_extendedprice - 40000 AS logit FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY abs(logit), id) AS k FROM p),
    m AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY (id * 7919) % 1000003, id) AS m FROM k WHERE k > 75)
    SELECT image, id FROM k WHERE k <= 75 UNION ALL SELECT image, id FROM m WHERE m <= 25
""")
def uncertain_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("image"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_extendedprice") - 40000).alias("logit"))
    return instances.uncertain_points(rows, 100, "image", 0.75, F.col("id") * 7919 % 1000003).select("image", "id")


@query(f"""
    WITH {BOXES}, k AS (SELECT id, x0 + (id * 13) % 60 AS kx, y0 + (id * 17) % 60 AS ky, id % 3 AS v FROM boxes)
    SELECT boxes.id FROM boxes JOIN k USING (id) WHERE v >= 1 AND kx >= x0 AND kx <= x1 AND ky >= y0 AND ky <= y1
""")
def visible_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    rows = boxes(spark, sf_dir)
    pts = rows.select("id", (F.col("x0") + k * 13 % 60).alias("kx"), (F.col("y0") + k * 17 % 60).alias("ky"), (k % 3).alias("v"))
    return instances.with_visible_keypoint(rows, pts).select("id")


@query(f"""
    WITH {BOXES}, m AS (SELECT id, x0, y0, x1, y1, x0 + 4 AS u0, y0 - 6 AS v0, x1 + 2 AS u1, y1 + 3 AS v1 FROM boxes), i AS (SELECT id, greatest(0, least(x1, u1) - greatest(x0, u0)) * greatest(0, least(y1, v1) - greatest(y0, v0)) AS inter, (x1 - x0) * (y1 - y0) + (u1 - u0) * (v1 - v0) AS total FROM m)
    SELECT id, round(inter / (total - inter), 6) AS iou FROM i
""")
def matched_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    moved = rows.select("id", (F.col("x0") + 4).alias("x0"), (F.col("y0") - 6).alias("y0"), (F.col("x1") + 2).alias("x1"), (F.col("y1") + 3).alias("y1"))
    return instances.matched_iou(rows, moved).select("id", r("iou", 6).alias("iou"))


@query(f"""
    WITH {BOXES}, p AS (SELECT p_partkey AS id, (p_partkey * 7919) % 1000 AS x, (p_partkey * 104729 + p_size * 13) % 1000 AS y FROM part)
    SELECT id, CAST(x - x0 AS DOUBLE) AS l, CAST(y - y0 AS DOUBLE) AS t, CAST(x1 - x AS DOUBLE) AS rr, CAST(y1 - y AS DOUBLE) AS b FROM boxes JOIN p USING (id)
""")
def point_box_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).join(points(spark, sf_dir).select("id", "x", "y"), "id")
    left, top, right, bottom = geometry.point_box_distances(F.col("x"), F.col("y"), Box.of())
    return rows.select("id", left.alias("l"), top.alias("t"), right.alias("rr"), bottom.alias("b"))


@query("""
    WITH p AS (SELECT l_returnflag AS channel, quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.998) AS hi FROM lineitem GROUP BY ALL) SELECT channel, round(lo, 4) AS low, round(hi, 4) AS high FROM p
""")
def auto_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("channel"), F.col("l_extendedprice").alias("value"))
    return render.auto_contrast(rows).select("channel", r("low").alias("low"), r("high").alias("high"))


@query("""
    WITH p AS (SELECT l_partkey AS y, l_suppkey AS x, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS channel, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL),
    t AS (SELECT y, x, channel, pow(least(1.0, greatest(0.0, (value - 1000) / (CASE channel WHEN 0 THEN 80000 ELSE 50000 END - 1000))), 1 / 2.0) AS t FROM p)
    SELECT y, x, CAST(floor(least(1.0, sum(CASE channel WHEN 0 THEN t ELSE 0.2 * t END)) * 255 + 0.5) AS INT) AS red, CAST(floor(least(1.0, sum(CASE channel WHEN 0 THEN 0.0 ELSE t END)) * 255 + 0.5) AS INT) AS green,
        CAST(floor(least(1.0, sum(0.5 * t)) * 255 + 0.5) AS INT) AS blue FROM t GROUP BY ALL
""")
def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("y"), F.col("l_suppkey").alias("x"), F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("channel")).agg(F.max("l_extendedprice").alias("value"))
    return render.composite(rows, {0: (1000, 80000, (1.0, 0.0, 0.5)), 1: (1000, 50000, (0.2, 1.0, 0.5))}, gamma=2.0)


@query(f"""
    WITH {BOXES}, runs AS (SELECT id, unnest(range(y0, y1)) AS y, x0, x1 FROM boxes), s AS (SELECT id, y, x0 + 2 * (y % 2) AS x0, x1 FROM runs), p AS (SELECT id, y, unnest(range(x0, x1)) AS x FROM s)
    SELECT (y - 200) // 4 AS y, (x - 100) // 4 AS x, min(id) AS id FROM p WHERE y >= 200 AND y < 900 AND x >= 100 AND x < 1100 GROUP BY ALL
""")
def mask_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.overlay(box_runs(spark, sf_dir), 100, 200, 1100, 900, 4)


@query(f"WITH {BOXES} SELECT id, 1501 - x1 AS flipped, round(x0 * 0.5, 6) AS resized, CAST(least(greatest(y0 - 300, 0), 500) AS BIGINT) AS cropped FROM boxes")
def moved_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.of()
    return boxes(spark, sf_dir).select("id", render.flip(b, 1501).x0.alias("flipped"), r(render.resize(b, (1501, 2003), (750.5, 4006)).x0, 6).alias("resized"), big(render.crop(b, 200, 300, 700, 500).y0).alias("cropped"))


@query("""
    WITH p AS (SELECT p_partkey AS id, CAST(p_retailprice AS DOUBLE) AS price, CAST(p_size AS DOUBLE) AS size FROM part)
    SELECT id, '{"gap":' || CASE WHEN id % 5 = 0 THEN 'null' ELSE CAST(id AS VARCHAR) END || ',"size":' || CAST(CAST(size AS INT) AS VARCHAR) || '}' AS features FROM p
""")
def features_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey")).alias("gap"), F.col("p_size").alias("size"))
    return rows.select("id", phenotype.features_json(["size", "gap"]).alias("features"))


@query("""
    WITH px AS (SELECT o_orderkey // 100 AS y, o_orderkey % 100 AS x, o_custkey % 7 AS cell, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 7 ELSE 0 END AS nucleus FROM orders),
    c AS (SELECT p.y, p.x, p.cell, p.nucleus = p.cell AS nuclear FROM px p WHERE cell > 0), n AS (SELECT y, x, nucleus FROM px WHERE nucleus > 0),
    o AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) t(dy, dx)), near AS (SELECT n.y + dy AS y, n.x + dx AS x, arg_min(nucleus, (dy * dy + dx * dx, nucleus)) AS near FROM n, o GROUP BY ALL)
    SELECT c.y, c.x, cell, nuclear, NOT nuclear AS cytoplasm, NOT nuclear AND coalesce(near = cell, false) AS ring FROM c LEFT JOIN near USING (y, x)
""")
def compartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = label_pixels(spark, sf_dir)
    k = F.col("o_orderkey")
    nuclei = table(spark, sf_dir, "orders").select(F.floor(k / 100).alias("y"), (k % 100).alias("x"), F.when(k % 4 == 0, F.col("o_custkey") % 7).otherwise(0).alias("label"))
    return raster.compartments(cells, nuclei, 1).drop("membrane")


@query(suppressed("SELECT id, tile AS image, class_id, score, x0, y0, x1, y1 FROM boxes WHERE score > 950", ("image", "class_id"), 0.3) + """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, id) AS rank FROM stays) WHERE rank <= 100
""")
def class_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).withColumnRenamed("tile", "image").drop("area")
    return instances.detections(rows, 950.0, 0.3, 100)


@query(suppressed("""
    SELECT id, class_id, tile, score, cx - CASE WHEN id % 2 = 1 THEN h ELSE w END / 2 AS x0, cy - CASE WHEN id % 2 = 1 THEN w ELSE h END / 2 AS y0,
           cx + CASE WHEN id % 2 = 1 THEN h ELSE w END / 2 AS x1, cy + CASE WHEN id % 2 = 1 THEN w ELSE h END / 2 AS y1
    FROM (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x1 - x0 AS w, y1 - y0 AS h FROM boxes)
""", ("class_id", "tile"), 0.1) + " SELECT id, class_id, tile, score FROM stays")
def rotated_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes turned by quarters, which SQL can follow; other angles are in the tests."""
    cx, cy = Box.of().center
    rows = boxes(spark, sf_dir).select("id", "class_id", "tile", "score", cx.alias("cx"), cy.alias("cy"), Box.of().width.cast("double").alias("w"), Box.of().height.cast("double").alias("h"), (F.col("id") % 4 * 90).cast("double").alias("angle"))
    return matching.nms(rows, 0.1, ["class_id", "tile"], rotated=True).select("id", "class_id", "tile", "score")


@query()
def threshold_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of the heat map in tiles of 50 rows: a kernel for each."""
    rows = heat(spark, sf_dir).select(F.floor(F.col("y") / 50).alias("tile"), big("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), (F.col("value") / 2000).alias("value"))
    return raster.segment_tiles(rows, 60.0, sigma=1.5)


@query("""
    WITH p AS (SELECT o_custkey % 20 AS image, CAST(o_orderkey % 120 AS INT) AS x, CAST((o_orderkey // 120) % 4 AS INT) AS i FROM orders),
    t3 AS (SELECT DISTINCT image, x FROM p WHERE i = 3),
    n2 AS (SELECT image, count(*) AS n, count(*) FILTER ((image, x) NOT IN (SELECT (image, x) FROM t3)) AS free FROM p WHERE i = 2 GROUP BY image),
    t2 AS (SELECT DISTINCT image, x FROM p JOIN n2 USING (image) WHERE i = 2 AND (n - free) / n <= 0.5 AND (image, x) NOT IN (SELECT (image, x) FROM t3)),
    n1 AS (SELECT image, count(*) AS n, count(*) FILTER ((image, x) NOT IN (SELECT (image, x) FROM t3 UNION ALL SELECT (image, x) FROM t2)) AS free FROM p WHERE i = 1 GROUP BY image),
    t1 AS (SELECT DISTINCT image, x FROM p JOIN n1 USING (image) WHERE i = 1 AND (n - free) / n <= 0.5 AND (image, x) NOT IN (SELECT (image, x) FROM t3 UNION ALL SELECT (image, x) FROM t2)),
    things AS (SELECT *, 3 AS i FROM t3 UNION ALL SELECT *, 2 FROM t2 UNION ALL SELECT *, 1 FROM t1),
    taken AS (SELECT image, i FROM (SELECT DISTINCT image, 3 AS i FROM t3 UNION SELECT image, 2 FROM n2 WHERE (n - free) / n <= 0.5 UNION SELECT image, 1 FROM n1 WHERE (n - free) / n <= 0.5)),
    numbered AS (SELECT image, i, row_number() OVER (PARTITION BY image ORDER BY i DESC) AS segment FROM taken),
    s AS (SELECT image, x, x % 3 AS class FROM p WHERE i = 0 AND x % 3 > 0 AND (image, x) NOT IN (SELECT (image, x) FROM things)),
    big AS (SELECT image, class FROM s GROUP BY ALL HAVING count(*) >= 5),
    stuff AS (SELECT image, class, coalesce((SELECT max(segment) FROM numbered n WHERE n.image = big.image), 0) + row_number() OVER (PARTITION BY image ORDER BY class) AS segment FROM big)
    SELECT image, 0 AS y, x, CAST(segment AS INT) AS segment, CAST(10 + i AS INT) AS class FROM things JOIN numbered USING (image, i)
    UNION ALL SELECT DISTINCT image, 0, x, CAST(segment AS INT), CAST(class AS INT) FROM s JOIN stuff USING (image, class)
""")
def panoptic_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three instances an image that overlap, the best first, and two kinds of stuff where they leave room."""
    k = F.col("o_orderkey")
    instance = F.floor(k / 120) % 4
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 20).alias("image"), F.lit(0).alias("y"), (k % 120).cast("int").alias("x"), F.when(instance > 0, instance).cast("int").alias("instance"),
        F.when(instance > 0, 10 + instance).otherwise(k % 120 % 3).cast("int").alias("class"), (0.5 + instance / 10).cast("double").alias("score"),
    )
    return matching.panoptic_fusion(rows, 0.5, 5)


@query()
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the neighbour graph of sampled points; then every point by the nearest community's centre."""
    pts = points(spark, sf_dir)
    chosen = phenotype.sample(pts, "id", SAMPLE)
    weights = phenotype.knn_weights(joins.knn(chosen, NEIGHBOURS, 60))
    edges = [(e["a"], e["b"], e["weight"]) for e in weights.collect()]  # at most NEIGHBOURS for each sampled point
    nodes = [n["id"] for n in chosen.select("id").orderBy("id").collect()]
    label = spark.createDataFrame(list(phenotype.communities(edges, nodes).items()), "id long, label int")
    centers = chosen.join(F.broadcast(label) if at_most(label) else label, "id").groupBy("label").agg(F.array(F.avg("x"), F.avg("y")).alias("vector"))
    return joins.nearest_centroid(pts.select("id", F.array("x", "y").alias("vector")), centers).select("id", "label")


@query("""
    WITH px AS (SELECT o_orderkey // 100 AS y, o_orderkey % 100 AS x, o_custkey % 7 AS id FROM orders WHERE o_custkey % 7 > 0), g AS (SELECT id, y, x, x - row_number() OVER (PARTITION BY id, y ORDER BY x) AS g FROM px)
    SELECT id, y, min(x) AS x0, max(x) + 1 AS x1 FROM g GROUP BY id, y, g
""")
def mask_runs_from_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.to_runs(label_pixels(spark, sf_dir).where("label > 0").withColumnRenamed("label", "id"))


@query()
def track_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_ids() as a stream of files with state by video, written to a table."""
    from tesserae.plans.metrics import detections
    from tesserae.streaming import tracking

    folder = fresh_dir(spark, "tracks")
    detections(spark, sf_dir).repartitionByRange(1, "frame").sortWithinPartitions("frame").write.parquet(f"{folder}/in")
    source = spark.readStream.schema(detections(spark, sf_dir).schema).parquet(f"{folder}/in")
    out = tracking.track_stream(source, tracking.TrackOptions(threshold=0.4, patience=2))
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query()
def degree_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of the triangulation: their sum is twice its edges."""
    edges = graph.delaunay_graph(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7919 % 1000).alias("x"), (F.col("s_suppkey") * 104729 % 997).alias("y")))
    return graph.degrees(edges)
