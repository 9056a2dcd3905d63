"""Scalar, text, JSON and geometry expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.functions import geometry, nested, scalar
from tesserae.functions.geometry import Box
from tesserae.plans.registry import big, query, r, table
from tesserae.plans.spatial import BOXES, boxes


@query("SELECT c_custkey, round(asinh(c_acctbal / 5), 6) AS arcsinh, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS log1p FROM customer")
def arcsinh_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal").cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", r(scalar.arcsinh(x), 6).alias("arcsinh"), r(scalar.signed_log1p(x), 6).alias("log1p"))


@query("""
    SELECT c_custkey, CAST(floor(least(255.0, greatest(0.0, (c_acctbal + 500) * 255.0 / 9000))) AS INT) AS stretched, CAST(round_even((c_acctbal + 999.99) / 10999.98 * 255.0, 0) AS INT) AS rescaled,
        CAST(floor(c_acctbal / 100 + 0.5) AS BIGINT) AS half_up, CAST(round_even(c_acctbal / 100, 0) AS BIGINT) AS half_even, round(pow(least(1, greatest(0, c_acctbal / 8000)), 1 / 1.8) * 0.75, 6) AS tone
    FROM customer
""")
def intensity_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal").cast("double")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", scalar.to_uint8(x, -500.0, 8500.0).alias("stretched"), scalar.rescale_uint8(x, -999.99, 9999.99).alias("rescaled"),
        big(scalar.round_half_up(x / 100)).alias("half_up"), scalar.round_half_even(x / 100).alias("half_even"), r(scalar.tone(x, 0, 8000, 1.8, 0.75), 6).alias("tone"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event\":\"' || event_type || '\",\"user\":' || user_id || '}' AS canonical FROM events")
def json_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), scalar.canonical_json(user=F.col("user_id"), event=F.col("event_type")).alias("canonical"))


@query("SELECT p_partkey, sha256(p_partkey || '|' || p_name || '|' || p_size) AS mark FROM part")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalar.fingerprint(F.col("p_partkey"), F.col("p_name"), F.col("p_size")).alias("mark"))


@query("""
    WITH n AS (SELECT p_partkey, p_type || '/_' || p_name || CASE p_partkey % 3 WHEN 0 THEN '.ome.tiff' WHEN 1 THEN '.TIF' ELSE '.dat' END AS f FROM part),
    s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN f[:-10] WHEN 1 THEN f[:-5] ELSE f END AS f FROM n)
    SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(f, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), ''), 'image') AS stem FROM s
""")
def safe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("p_partkey") % 3 == 0, ".ome.tiff").when(F.col("p_partkey") % 3 == 1, ".TIF").otherwise(".dat")
    return table(spark, sf_dir, "part").select("p_partkey", scalar.safe_stem(F.concat("p_type", F.lit("/_"), "p_name", suffix)).alias("stem"))


@query("SELECT p_partkey, CAST(bit_count(p_partkey) AS INT) AS ones, CAST((p_partkey >> 3) & 1 AS INT) AS bit3, p_partkey // 1000 AS category, p_partkey % 1000 AS instance FROM part")
def bit_and_id_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", scalar.popcount(k).alias("ones"), scalar.bit(k, 3).cast("int").alias("bit3"), F.floor(k / 1000).alias("category"), (k % 1000).alias("instance"))


@query(f"""
    WITH {BOXES}, c AS (SELECT id, x1 - x0 AS w, y1 - y0 AS h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM boxes),
    d AS (SELECT id, 10 * 3 / w AS dx, 10 * (-2) / h AS dy, 5 * ln((w + 6) / w) AS dw, 5 * ln((h + 4) / h) AS dh, w, h, cx, cy FROM c)
    SELECT id, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dw, 6) AS dw, round(dh, 6) AS dh, round(dx / 10 * w + cx - exp(dw / 5) * w / 2, 6) AS x0, round(dh / 5, 6) AS scale_h FROM d
""")
def box_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.of()
    target = Box(b.x0, b.y0 - 4, b.x1 + 6, b.y1)
    dx, dy, dw, dh = geometry.encode_deltas(b, target)
    back = geometry.decode_deltas(b, dx, dy, dw, dh)
    return boxes(spark, sf_dir).select("id", r(dx, 6).alias("dx"), r(dy, 6).alias("dy"), r(dw, 6).alias("dw"), r(dh, 6).alias("dh"), r(back.x0, 6).alias("x0"), r(dh / 5, 6).alias("scale_h"))


@query(f"WITH {BOXES} SELECT id, CAST(least(greatest(floor(4 + log2(sqrt((x1 - x0) * (y1 - y0)) / 224 + 1e-8)), 1), 5) AS INT) AS level FROM boxes")
def fpn_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("id", geometry.fpn_level(F.col("area"), 1, 5).alias("level"))


@query(f"""
    WITH {BOXES}, t AS (SELECT id, (x0 + x1) / 2 AS cx, x1 - x0 AS w, y1 - y0 AS h, radians((id * 37) % 360) AS a, (id * 37) % 360 AS d FROM boxes)
    SELECT id, round(cx - (abs(cos(a)) * w + abs(sin(a)) * h) / 2, 5) AS left, round(cx + (abs(cos(a)) * w + abs(sin(a)) * h) / 2, 5) AS right, CAST((d + 180) % 360 - 180 AS DOUBLE) AS angle FROM t
""")
def rotated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, degrees = Box.of(), (F.col("id") * 37 % 360).cast("double")
    cx, cy = b.center
    e = geometry.rotated_extent(cx, cy, b.width, b.height, degrees)
    return boxes(spark, sf_dir).select("id", r(e.x0, 5).alias("left"), r(e.x1, 5).alias("right"), geometry.normalize_angle(degrees).alias("angle"))


@query(f"""
    WITH {BOXES}, p AS (SELECT a.*, a.x0 + 5 AS u0, a.y0 + 3 AS v0, a.x1 + 9 AS u1, a.y1 + 1 AS v1 FROM boxes a),
    i AS (SELECT id, greatest(0, least(x1, u1) - greatest(x0, u0)) * greatest(0, least(y1, v1) - greatest(y0, v0)) AS inter, (x1 - x0) * (y1 - y0) AS a1, (u1 - u0) * (v1 - v0) AS a2,
        pow((x0 + x1 - u0 - u1) / 2, 2) + pow((y0 + y1 - v0 - v1) / 2, 2) AS d, pow(greatest(x1, u1) - least(x0, u0), 2) + pow(greatest(y1, v1) - least(y0, v0), 2) AS c FROM p)
    SELECT id, round(inter / (a1 + a2 - inter), 6) AS iou, round(inter / a2, 6) AS ioa, round(1 - inter / (a1 + a2 - inter + 1e-7) + d / (c + 1e-7), 6) AS diou FROM i
""")
def box_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Box.of()
    b = Box(a.x0 + 5, a.y0 + 3, a.x1 + 9, a.y1 + 1)
    return boxes(spark, sf_dir).select("id", r(geometry.iou(a, b), 6).alias("iou"), r(geometry.ioa(a, b), 6).alias("ioa"), r(geometry.diou_loss(a, b), 6).alias("diou"))


@query(f"WITH {BOXES} SELECT id, CAST((x1 - x0) * (y1 - y0) - 0.5 * 4 * 3 AS DOUBLE) AS area FROM boxes")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each box with a corner cut off, as a polygon of five corners."""
    d = lambda c: c.cast("double")
    b = Box.of()
    xs = F.array(d(b.x0), d(b.x1), d(b.x1), d(b.x0 + 4), d(b.x0))
    ys = F.array(d(b.y0), d(b.y0), d(b.y1), d(b.y1), d(b.y1 - 3))
    return boxes(spark, sf_dir).select("id", geometry.shoelace(xs, ys).alias("area"))


@query("""
    WITH s AS (SELECT p_partkey, 200 + p_size * 13 AS h, 100 + p_partkey % 900 AS w FROM part), a AS (SELECT p_partkey, h, w, 800 / least(h, w) AS s FROM s), b AS (SELECT p_partkey, h * s AS h, w * s AS w FROM a)
    SELECT p_partkey, CAST(floor(h * least(1, 1333 / greatest(h, w)) + 0.5) AS INT) AS height, CAST(floor(w * least(1, 1333 / greatest(h, w)) + 0.5) AS INT) AS width FROM b
""")
def resize_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, w = scalar.shortest_edge(200 + F.col("p_size") * 13, 100 + F.col("p_partkey") % 900, 800, 1333)
    return table(spark, sf_dir, "part").select("p_partkey", h.alias("height"), w.alias("width"))


@query(f"WITH {BOXES}, a AS (SELECT * FROM (VALUES (32, 0.5), (32, 1.0), (64, 0.5), (64, 1.0)) t(size, ratio)) SELECT id, size, CAST(ratio AS DOUBLE) AS ratio, round(x0 - sqrt(size * size / ratio) / 2, 6) AS left, round(y0 + sqrt(size * size / ratio) * ratio / 2, 6) AS bottom FROM boxes, a")
def anchor_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors at each box's corner: a literal array, not a join."""
    made = [(s, ratio, *a) for (s, ratio), a in zip([(32, 0.5), (32, 1.0), (64, 0.5), (64, 1.0)], geometry.anchors((32, 64), (0.5, 1.0)), strict=True)]
    cells = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(q).alias("ratio"), F.lit(a).alias("l"), F.lit(d).alias("b")) for s, q, a, _, _, d in made])
    rows = boxes(spark, sf_dir).select("id", "x0", "y0", F.explode(cells).alias("a"))
    return rows.select("id", F.col("a.size").alias("size"), F.col("a.ratio").alias("ratio"), r(F.col("x0") + F.col("a.l"), 6).alias("left"), r(F.col("y0") + F.col("a.b"), 6).alias("bottom"))


@query("SELECT c_mktsegment, count(*) AS n, round(pow(count(*), -0.5), 8) AS weight, round(least(1, greatest(0, count(*) / 400)), 6) AS progress FROM customer GROUP BY ALL")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return rows.select("c_mktsegment", "n", r(scalar.class_weight("n", -0.5), 8).alias("weight"), r(scalar.progress("n", F.lit(400)), 6).alias("progress"))


@query(f"""
    WITH {BOXES}, k AS (SELECT id, x0, y0, x1, y1, x0 + (id * 7) % 80 AS kx, y0 + (id * 11) % 80 AS ky FROM boxes),
    c AS (SELECT id, CASE WHEN kx = x1 THEN 55 ELSE CAST(floor((kx - x0) * 56 / (x1 - x0)) AS BIGINT) END AS cx, CASE WHEN ky = y1 THEN 55 ELSE CAST(floor((ky - y0) * 56 / (y1 - y0)) AS BIGINT) END AS cy FROM k)
    SELECT id, cx, cy, cx >= 0 AND cy >= 0 AND cx < 56 AND cy < 56 AS valid FROM c
""")
def keypoint_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    cx, cy, ok = geometry.keypoint_to_heatmap(F.col("x0") + k * 7 % 80, F.col("y0") + k * 11 % 80, Box.of(), 56)
    return boxes(spark, sf_dir).select("id", cx.alias("cx"), cy.alias("cy"), ok.alias("valid"))


@query("""
    SELECT s_suppkey AS id, s_suppkey % 7 AS "a/b", 'n' || s_suppkey AS "a/c/d", round(s_acctbal, 2) AS "a/c/e" FROM supplier
""")
def flattened_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    inner = F.struct(F.concat(F.lit("n"), k.cast("string")).alias("d"), r("s_acctbal", 2).alias("e"))
    return nested.flattened(table(spark, sf_dir, "supplier").select(k.alias("id"), F.struct((k % 7).alias("b"), inner.alias("c")).alias("a")))


@query("""
    SELECT s_suppkey AS id, '{"a":{"keep":' || s_suppkey || '},"l":[{"keep":1}]}' AS config FROM supplier
""")
def json_without_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('{"a":{"keep":'), k, F.lit(',"threshold_algorithm":"x"},"l":[{"keep":1,"threshold_algorithm":2}],"threshold_algorithm":3}'))
    kept = nested.json_without(text, "struct<a:struct<keep:long,threshold_algorithm:string>,l:array<struct<keep:long,threshold_algorithm:long>>,threshold_algorithm:long>", "threshold_algorithm")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), kept.alias("config"))
