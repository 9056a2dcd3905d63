"""Evaluation, time series and stateful processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.operators import evaluation, matching
from tesserae.plans.registry import big, query, r, table
from tesserae.plans.spatial import BOXES, boxes, suppressed
from tesserae.session import fresh_dir
from tesserae.streaming import incremental, metrics, tracking

# detections and ground truths: boxes by tile (the image), odd and even part numbers
SIDES = """
    gt AS (SELECT tile AS image, class_id AS class, id, id % 11 = 0 AS difficult, x0, y0, x1, y1 FROM boxes WHERE (id // 4) % 2 = 0),
    det AS (SELECT tile AS image, class_id AS class, id, score, x0, y0, x1, y1 FROM boxes WHERE (id // 4) % 2 = 1)
"""
VOC = """
    pairs AS (SELECT det.image, det.class, det.id AS det, det.score, gt.id AS gt, gt.difficult, greatest(0, least(gt.x1, det.x1) - greatest(gt.x0, det.x0) + 1) * greatest(0, least(gt.y1, det.y1) - greatest(gt.y0, det.y0) + 1) AS inter,
        (gt.x1 - gt.x0 + 1) * (gt.y1 - gt.y0 + 1) + (det.x1 - det.x0 + 1) * (det.y1 - det.y0 + 1) AS total FROM det LEFT JOIN gt ON gt.image = det.image AND gt.class = det.class),
    best AS (SELECT image, class, det, score, max(coalesce(inter / (total - inter), -1)) AS ov, arg_max(gt, (coalesce(inter / (total - inter), -1), -gt)) AS gt, arg_max(difficult, (coalesce(inter / (total - inter), -1), -gt)) AS difficult FROM pairs GROUP BY ALL),
    hit AS (SELECT image, class, det, score, CASE WHEN ov > 0.1 THEN gt END AS gt, difficult FROM best),
    turn AS (SELECT *, row_number() OVER (PARTITION BY image, class, gt ORDER BY score DESC, det) AS k FROM hit),
    matched AS (SELECT image, class, det, score, gt IS NOT NULL AND k = 1 AS tp FROM turn WHERE NOT (gt IS NOT NULL AND coalesce(difficult, false))),
    npos AS (SELECT class, count(*) FILTER (NOT difficult) AS npos FROM gt GROUP BY ALL),
    run AS (SELECT class, score, det, sum(tp::INT) OVER w AS tp, count(*) OVER w AS n, npos FROM matched JOIN npos USING (class) WINDOW w AS (PARTITION BY class ORDER BY score DESC, det ROWS UNBOUNDED PRECEDING)),
    curve AS (SELECT class, score, det, tp / n AS precision, tp / npos AS recall, max(tp / n) OVER (PARTITION BY class ORDER BY score DESC, det ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM run)
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = boxes(spark, sf_dir).select(F.col("tile").alias("image"), F.col("class_id").alias("class"), "id", "score", "x0", "y0", "x1", "y1")
    even = F.floor(F.col("id") / 4) % 2 == 0
    return rows.where(even).withColumn("difficult", F.col("id") % 11 == 0).drop("score"), rows.where(~even)


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, det = _sides(spark, sf_dir)
    positives = gt.groupBy("class").agg(F.count_if(~F.col("difficult")).alias("npos"))
    return evaluation.precision_recall(evaluation.voc_matches(gt, det, 0.1), positives)


@query(f"WITH {BOXES}, {SIDES}, {VOC} SELECT class, det, round(precision, 6) AS precision, round(recall, 6) AS recall, round(envelope, 6) AS envelope FROM curve")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir).select("class", "det", *[r(c, 6).alias(c) for c in ("precision", "recall", "envelope")])


_AP11 = " + ".join(f"coalesce(max(precision) FILTER (recall >= {k / 10}), 0)" for k in range(11))


@query(f"""
    WITH {BOXES}, {SIDES}, {VOC}, s AS (SELECT *, recall - coalesce(lag(recall) OVER (PARTITION BY class ORDER BY score DESC, det), 0) AS step FROM curve)
    SELECT class, round(sum(step * envelope), 6) AS ap, round(({_AP11}) / 11, 6) AS ap11 FROM s GROUP BY class
""")
def voc_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.average_precision(_curve(spark, sf_dir)).select("class", r("ap", 6).alias("ap"), r("ap11", 6).alias("ap11"))


_SWEEP = VOC.replace("best AS (SELECT", "steps AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS t), best AS (SELECT")
_SWEEP = _SWEEP.replace("hit AS (SELECT image, class, det, score, CASE WHEN ov > 0.1 THEN gt END AS gt, difficult FROM best)", "hit AS (SELECT t, image, class, det, score, CASE WHEN ov > t THEN gt END AS gt, difficult FROM best, steps)")
_SWEEP = _SWEEP.replace("PARTITION BY image, class, gt", "PARTITION BY t, image, class, gt").replace("matched AS (SELECT image", "matched AS (SELECT t, image").replace("PARTITION BY class ORDER", "PARTITION BY t, class ORDER")
_SWEEP = _SWEEP.replace("run AS (SELECT class", "run AS (SELECT t, class").replace("curve AS (SELECT class", "curve AS (SELECT t, class")


@query(f"""
    WITH {BOXES}, {SIDES}, {_SWEEP}, s AS (SELECT *, recall - coalesce(lag(recall) OVER (PARTITION BY t, class ORDER BY score DESC, det), 0) AS step FROM curve)
    SELECT class, round(t, 2) AS iou_step, round(sum(step * envelope), 6) AS ap, round(({_AP11}) / 11, 6) AS ap11 FROM s GROUP BY class, t
""")
def voc_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.voc_report(*_sides(spark, sf_dir))
    return found.select("class", r("iou_step", 2).alias("iou_step"), r("ap", 6).alias("ap"), r("ap11", 6).alias("ap11"))


COCO = """
    c AS (SELECT det.image, det.class, det.id AS det, det.score, row_number() OVER (PARTITION BY det.image, det.class ORDER BY det.score DESC, det.id) AS k FROM det QUALIFY k <= 100),
    sides AS (SELECT DISTINCT image, class FROM det UNION SELECT DISTINCT image, class FROM gt),
    pairs AS (SELECT c.image, c.class, c.k, gt.id AS gt, gt.id % 13 = 0 AS crowd, greatest(0, least(gt.x1, d.x1) - greatest(gt.x0, d.x0)) * greatest(0, least(gt.y1, d.y1) - greatest(gt.y0, d.y0)) AS inter,
        (gt.x1 - gt.x0) * (gt.y1 - gt.y0) AS ga, (d.x1 - d.x0) * (d.y1 - d.y0) AS da FROM c JOIN det d ON d.id = c.det JOIN gt ON gt.image = c.image AND gt.class = c.class),
    rated AS (SELECT image, class, k, gt, crowd, inter / CASE WHEN crowd THEN da ELSE ga + da - inter END AS iou FROM pairs WHERE inter > 0),
    able AS (SELECT c.image, c.class, c.k, c.det, c.score, coalesce(list({'gt': gt, 'crowd': crowd, 'iou': iou} ORDER BY iou DESC, gt) FILTER (gt IS NOT NULL), []) AS found FROM c LEFT JOIN rated USING (image, class, k) GROUP BY ALL),
    steps AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS t),
    walk AS (SELECT image, class, t, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS won, false AS crowd FROM sides, steps
             UNION ALL SELECT image, class, t, k, CASE WHEN real IS NOT NULL THEN list_append(taken, real) ELSE taken END, coalesce(real, mass), real IS NULL AND mass IS NOT NULL FROM (
                 SELECT w.image, w.class, w.t, w.k + 1 AS k, w.taken, list_filter(a.found, lambda x: x.iou >= w.t AND NOT x.crowd AND NOT list_contains(w.taken, x.gt))[1].gt AS real, list_filter(a.found, lambda x: x.iou >= w.t AND x.crowd)[1].gt AS mass
                 FROM walk w JOIN able a ON a.image = w.image AND a.class = w.class AND a.k = w.k + 1)),
    matched AS (SELECT w.class, w.t, a.score, a.det, w.won IS NOT NULL AS tp FROM walk w JOIN able a ON a.image = w.image AND a.class = w.class AND a.k = w.k WHERE NOT w.crowd),
    npos AS (SELECT class, count(*) AS npos FROM gt WHERE id % 13 <> 0 GROUP BY class),
    run AS (SELECT class, t, score, det, sum(tp::INT) OVER w / count(*) OVER w AS precision, sum(tp::INT) OVER w / npos AS recall FROM matched JOIN npos USING (class) WINDOW w AS (PARTITION BY class, t ORDER BY score DESC, det ROWS UNBOUNDED PRECEDING)),
    curve AS (SELECT class, t, recall, max(precision) OVER (PARTITION BY class, t ORDER BY score DESC, det ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM run),
    points AS (SELECT class, t, r, coalesce(max(envelope) FILTER (recall >= r / 100 - 1e-12), 0) AS p FROM curve, (SELECT unnest(range(0, 101)) AS r) GROUP BY ALL)
"""


@query(f"WITH RECURSIVE {BOXES}, {SIDES}, {COCO} SELECT class, round(t, 2) AS iou_step, round(avg(p), 6) AS ap FROM points GROUP BY class, t")
def coco_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, det = _sides(spark, sf_dir)
    gt = gt.withColumn("crowd", F.col("id") % 13 == 0)
    return evaluation.coco_ap(evaluation.coco_matches(gt, det), gt).select("class", r("iou_step", 2).alias("iou_step"), r("ap", 6).alias("ap"))


GREEDY = """
pairs AS (SELECT det.image, det.id AS pred, gt.id AS gt, greatest(0, least(gt.x1, det.x1) - greatest(gt.x0, det.x0)) * greatest(0, least(gt.y1, det.y1) - greatest(gt.y0, det.y0)) AS inter,
        (gt.x1 - gt.x0) * (gt.y1 - gt.y0) + (det.x1 - det.x0) * (det.y1 - det.y0) AS total FROM det JOIN gt USING (image)),
    ranked AS (SELECT image, pred, gt, inter / (total - inter) AS iou, row_number() OVER (PARTITION BY image ORDER BY inter / (total - inter) DESC, pred, gt) AS k FROM pairs WHERE inter > 0),
    walk AS (SELECT DISTINCT image, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS preds, CAST([] AS BIGINT[]) AS gts, false AS taken FROM pairs
             UNION ALL SELECT w.image, w.k + 1, CASE WHEN free THEN list_append(preds, pred) ELSE preds END, CASE WHEN free THEN list_append(gts, gt) ELSE gts END, free
             FROM (SELECT w.*, r.pred, r.gt, NOT list_contains(w.preds, r.pred) AND NOT list_contains(w.gts, r.gt) AS free FROM walk w JOIN ranked r ON r.image = w.image AND r.k = w.k + 1) w)
"""


@query(f"""
    WITH RECURSIVE {BOXES}, {SIDES}, {GREEDY}, n AS (SELECT count(*) AS n FROM gt WHERE image IN (SELECT image FROM det)), won AS (SELECT iou FROM ranked JOIN walk USING (image, k) WHERE taken),
    steps AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS t), r AS (SELECT t, (SELECT count(*) FROM won WHERE iou >= t) / n AS r FROM steps, n)
    SELECT round(avg(r), 6) AS ar, (SELECT n FROM n) AS num_pos FROM r
""")
def proposal_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, det = _sides(spark, sf_dir)
    return evaluation.proposal_recall(gt, det, 1_000_000).select(r("ar", 6).alias("ar"), "num_pos")


@query(f"""
    WITH RECURSIVE {BOXES}, {SIDES}, {GREEDY}
    SELECT image, pred, gt, round(iou, 6) AS iou FROM ranked JOIN walk USING (image, k) WHERE taken
""")
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, det = _sides(spark, sf_dir)
    return matching.greedy_one_to_one(det, gt).select("image", "pred", "gt", r("iou", 6).alias("iou"))


@query(suppressed("""SELECT * FROM (SELECT id, tile AS image, class_id AS level, score, x0, y0, x1, y1, row_number() OVER (PARTITION BY tile, class_id ORDER BY score DESC, id) AS top FROM boxes) WHERE top <= 1000""", ("image", "level"), 0.5) + """
    SELECT * FROM (SELECT id, image, level, score, x0, y0, x1, y1, row_number() OVER (PARTITION BY image ORDER BY score DESC, id) AS rank FROM stays) WHERE rank <= 100
""")
def top_k_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select("id", F.col("tile").alias("image"), F.col("class_id").alias("level"), "score", "x0", "y0", "x1", "y1")
    return matching.top_k_nms(rows, 1000, 100, 0.5)


CONFUSION = "m AS (SELECT CAST(l_suppkey % 5 AS INT) AS gt, CAST((l_suppkey + CASE WHEN l_quantity > 30 THEN l_linenumber ELSE 0 END) % 5 AS INT) AS pred FROM lineitem), c AS (SELECT CASE WHEN gt = 4 THEN 5 ELSE gt END AS gt, pred, count(*) AS n FROM m GROUP BY ALL)"


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select((k % 5).cast("int").alias("gt"), ((k + F.when(F.col("l_quantity") > 30, F.col("l_linenumber")).otherwise(0)) % 5).cast("int").alias("pred"))
    return evaluation.confusion(rows, "gt", "pred", 5, ignore=4)


@query(f"WITH {CONFUSION} SELECT gt, pred, n FROM c")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir)


EACH = """
    i AS (SELECT * FROM c WHERE gt < 5 AND pred < 5), p AS (SELECT gt AS c, sum(n) AS pos, sum(n) FILTER (gt = pred) AS tp FROM i GROUP BY ALL), g AS (SELECT pred AS c, sum(n) AS got FROM i GROUP BY ALL),
    e AS (SELECT c, coalesce(pos, 0) AS pos, coalesce(got, 0) AS got, coalesce(tp, 0) AS tp FROM p FULL JOIN g USING (c))
"""


@query(f"""
    WITH {CONFUSION}, {EACH} SELECT round(100 * avg(CASE WHEN pos > 0 THEN tp / (pos + got - tp) END), 6) AS miou, round(100 * sum(CASE WHEN pos > 0 THEN tp / (pos + got - tp) * pos END) / sum(pos), 6) AS fwiou,
        round(100 * avg(CASE WHEN pos > 0 THEN tp / pos END), 6) AS macc, round(100 * sum(tp) / sum(pos), 6) AS pacc FROM e
""")
def miou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.segmentation_scores(_confusion(spark, sf_dir), 5).select(*[r(c, 6).alias(c) for c in ("miou", "fwiou", "macc", "pacc")])


@query(f"WITH {CONFUSION}, {EACH} SELECT c, round(tp / nullif(pos + got - tp, 0), 6) AS iou, round(tp / nullif(pos, 0), 6) AS acc FROM e")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_scores(_confusion(spark, sf_dir), 5).select("c", r("iou", 6).alias("iou"), r("acc", 6).alias("acc"))


@query("""
    WITH j AS (SELECT quality AS gt, CASE WHEN length(text) > 2000 THEN 1 ELSE toxic END AS pred FROM labels JOIN documents USING (doc_id))
    SELECT round(count(*) FILTER (gt = pred) / count(*), 6) AS cls_accuracy, round(count(*) FILTER (gt = 0 AND pred = 0) / nullif(count(*) FILTER (gt = 0), 0), 6) AS fg_cls_accuracy,
        round(count(*) FILTER (gt = 0 AND pred = 1) / nullif(count(*) FILTER (gt = 0), 0), 6) AS false_negative FROM j
""")
def foreground_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    pred = F.when(F.col("n") > 2000, 1).otherwise(F.col("toxic"))
    return evaluation.accuracy(rows, F.col("quality"), pred, 1).select(*[r(c, 6).alias(c) for c in ("cls_accuracy", "fg_cls_accuracy", "false_negative")])


PANOPTIC = """
    px AS (SELECT o_custkey % 40 AS image, o_orderkey % 3 AS gt_class, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 + o_orderkey % 3 END AS gt, CASE WHEN o_orderkey % 7 = 0 THEN (o_orderkey + 1) % 3 ELSE o_orderkey % 3 END AS pred_class,
        1 + CASE WHEN o_orderkey % 7 = 0 THEN (o_orderkey + 1) % 3 ELSE o_orderkey % 3 END AS pred FROM orders)
"""


@query(f"""
    WITH {PANOPTIC}, b AS (SELECT image, gt, pred, gt_class, pred_class, count(*) AS n FROM px GROUP BY ALL),
    g AS (SELECT image, gt, gt_class, sum(n) AS ga FROM b WHERE gt <> 0 GROUP BY ALL), p AS (SELECT image, pred, pred_class, sum(n) AS pa, sum(CASE WHEN gt = 0 THEN n ELSE 0 END) AS va FROM b WHERE pred <> 0 GROUP BY ALL),
    m AS (SELECT b.image, b.gt, b.pred, b.gt_class, n / (ga + pa - n - va) AS iou FROM b JOIN g ON g.image = b.image AND g.gt = b.gt AND g.gt_class = b.gt_class JOIN p ON p.image = b.image AND p.pred = b.pred AND p.pred_class = b.pred_class
          WHERE b.gt <> 0 AND b.pred <> 0 AND b.gt_class = b.pred_class AND n / (ga + pa - n - va) > 0.5),
    t AS (SELECT gt_class AS class, count(*) AS tp, sum(iou) AS iou FROM m GROUP BY ALL),
    fn AS (SELECT gt_class AS class, count(*) AS fn FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image = g.image AND m.gt = g.gt) GROUP BY ALL),
    fp AS (SELECT pred_class AS class, count(*) AS fp FROM p WHERE va <= 0.5 * pa AND NOT EXISTS (SELECT 1 FROM m WHERE m.image = p.image AND m.pred = p.pred) GROUP BY ALL),
    s AS (SELECT class, coalesce(tp, 0) AS tp, coalesce(iou, 0) AS iou, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp FROM t FULL JOIN fn USING (class) FULL JOIN fp USING (class))
    SELECT class, round(coalesce(iou / nullif(tp, 0), 0) * tp / (tp + 0.5 * fp + 0.5 * fn), 6) AS pq, round(coalesce(iou / nullif(tp, 0), 0), 6) AS sq, round(tp / (tp + 0.5 * fp + 0.5 * fn), 6) AS rq FROM s
""")
def panoptic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pred = F.when(k % 7 == 0, (k + 1) % 3).otherwise(k % 3)
    px = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("image"), (k % 3).alias("gt_class"), F.when(k % 10 == 0, 0).otherwise(1 + k % 3).cast("long").alias("gt"), pred.alias("pred_class"), (1 + pred).alias("pred"))
    return evaluation.panoptic_quality(px).select("class", *[r(c, 6).alias(c) for c in ("pq", "sq", "rq")])


@query("""
    WITH p AS (SELECT o_custkey AS image, o_orderkey % 4 AS instance, (o_orderkey // 7) % 3 AS semantic, o_orderkey AS x FROM orders), v AS (SELECT image, instance, semantic, count(*) AS n FROM p WHERE instance > 0 GROUP BY ALL),
    w AS (SELECT image, instance, arg_max(semantic, (n, -semantic)) AS cls FROM v GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image, cls ORDER BY instance) AS k FROM w), s AS (SELECT image, semantic, count(*) AS area FROM p WHERE instance = 0 GROUP BY ALL)
    SELECT p.x, CASE WHEN p.instance > 0 THEN cls * 1000 + k WHEN area >= 2 THEN p.semantic * 1000 ELSE 0 END AS panoptic FROM p LEFT JOIN k USING (image, instance) LEFT JOIN s USING (image, semantic)
""")
def majority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    px = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), F.lit(0).alias("y"), k.alias("x"), (k % 4).alias("instance"), (F.floor(k / 7) % 3).alias("semantic"))
    return matching.majority_merge(px, 1000, 2).select("x", "panoptic")


@query("SELECT event_type, event_id, round(median(value) OVER w, 6) AS median, count(value) OVER w AS samples FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 199 PRECEDING AND CURRENT ROW)")
def smoothed_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.windowed_median(table(spark, sf_dir, "events"), "event_type", "value", "event_id", 200).select("event_type", "event_id", r("median", 6).alias("median"), "samples")


@query("WITH e AS (SELECT event_type, max(event_id) AS e FROM events GROUP BY ALL) SELECT event_type, round(median(value), 6) AS median, count(value) AS samples FROM events JOIN e USING (event_type) WHERE event_id > e - 500 GROUP BY ALL")
def last_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_median(table(spark, sf_dir, "events"), "event_type", "value", "event_id", 500).select("event_type", r("median", 6).alias("median"), "samples")


@query("SELECT event_type, arg_max(value, event_id) AS value, max(event_id) AS at FROM events GROUP BY ALL")
def latest_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest(table(spark, sf_dir, "events"), "event_type", "value", "event_id")


@query("""
    SELECT l_returnflag, CASE WHEN l_quantity = 50 THEN 9 ELSE CAST(floor((l_quantity - 0.0) / 5.0) AS BIGINT) END AS bin, count(*) AS n, round(sum(l_quantity), 4) AS total, round(sum(l_quantity * l_quantity), 4) AS total_sq
    FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY ALL
""")
def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.histogram(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", 0.0, 50.0, 10)
    return out.select("l_returnflag", "bin", "n", r("total").alias("total"), r("total_sq").alias("total_sq"))


@query("SELECT quantile_disc(value, 0.01) AS p1, quantile_disc(value, 0.05) AS p5, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")
def timing_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.timing_percentiles(table(spark, sf_dir, "events"), "value")


@query("""
    WITH e AS (SELECT * FROM (VALUES ('price', 'avg', 25000.0, 100000.0), ('price', 'max', 1.0, 0.5), ('price', 'none', 1.0, 0.5)) t(task, metric, value, tolerance)),
    a AS (SELECT 'avg' AS metric, avg(l_extendedprice) AS actual FROM lineitem UNION ALL SELECT 'max', max(l_extendedprice) FROM lineitem)
    SELECT task, metric, coalesce(abs(actual - value) <= tolerance, false) AS ok FROM e LEFT JOIN a USING (metric)
""")
def expected_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").agg(F.avg("l_extendedprice").alias("avg"), F.max("l_extendedprice").alias("max")).withColumn("task", F.lit("price"))
    results = rows.unpivot(["task"], ["avg", "max"], "metric", "value")
    expected = spark.createDataFrame([("price", "avg", 25000.0, 100000.0), ("price", "max", 1.0, 0.5), ("price", "none", 1.0, 0.5)], "task string, metric string, value double, tolerance double")
    return evaluation.check_expected(results, expected).select("task", "metric", "ok")


@query("""
    SELECT user_id, event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, count(*) FILTER (value > 0.5) AS n_positive FROM events GROUP BY ALL
""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a file stream into an additive upsert, until all is read; then the merged table."""
    folder = fresh_dir(spark, "upsert")
    schema = table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    one = not incremental.is_folder(spark, f"{sf_dir}/events.parquet")
    source = files.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if one else files.parquet(f"{sf_dir}/events.parquet")
    job = incremental.upsert_stream(source, f"{folder}/batches", f"{folder}/checkpoint", ["user_id", "event_type"], "value", 0.5)
    job.awaitTermination()
    out = incremental.merged(spark, f"{folder}/batches", ["user_id", "event_type"])
    return out.select("user_id", "event_type", "n", r("total").alias("total"), "low", "high", "n_positive")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that drift from event to event: a user is a video, an event is a frame with one box."""
    side = F.col("value") * 10
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("frame"), F.lit(0).cast("long").alias("det"), side.alias("x0"), (F.col("event_id") % 50).cast("double").alias("y0"))
    return rows.select("*", (F.col("x0") + 60).alias("x1"), (F.col("y0") + 60).alias("y1"))


@query()
def track_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.track(detections(spark, sf_dir), tracking.TrackOptions(threshold=0.4, patience=2))


@query()
def track_ids_hungarian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.track(detections(spark, sf_dir), tracking.TrackOptions("hungarian", 0.4, 2))


@query("SELECT CAST(count(*) AS BIGINT) AS units, CAST(count(DISTINCT s_suppkey) AS BIGINT) AS tiles FROM supplier")
def resumed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units done in two goes through a work log: what the first go completed isn't done again."""
    log = incremental.WorkLog(spark, fresh_dir(spark, "log"), {"job": "demo"})
    units = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("unit"))
    log.run(units.where("unit < '5'"), lambda left: left)
    done = log.run(units, lambda left: left)
    return done.agg(F.count("*").alias("units"), F.count_distinct("unit").alias("tiles"))


@query("SELECT user_id, count(*) AS frames, CAST(max(event_id) AS BIGINT) AS last FROM events GROUP BY ALL")
def video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).groupBy(F.col("video").alias("user_id")).agg(F.count("*").alias("frames"), big(F.max("frame")).alias("last"))
