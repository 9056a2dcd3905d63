"""Ranking, sampling, sharding and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.operators import sampling
from tesserae.plans.registry import big, query, r, table
from tesserae.sources import annotations


@query("""
    WITH k AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
    SELECT o_custkey, o_orderkey, rank FROM k WHERE rank <= 3
""")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sampling.top_per(rows, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("""
    WITH m AS (SELECT l_orderkey AS root, l_orderkey * 10 + l_linenumber AS id, l_linestatus = 'F' AS owned, l_returnflag = 'R' AS at_edge, l_discount AS score, CAST(l_quantity AS BIGINT) AS area FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY owned DESC, at_edge, score DESC, area DESC, id) AS k FROM m)
    SELECT root, max(CASE WHEN k = 1 THEN id END) AS representative, count(*) AS source_count, count(*) FILTER (owned) AS owned_count, min(id) AS first_member FROM k GROUP BY ALL
""")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("root"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_linestatus") == "F").alias("owned"),
        (F.col("l_returnflag") == "R").alias("at_edge"), F.col("l_discount").alias("score"), big("l_quantity").alias("area"),
    )
    return sampling.representative(rows, "root")


PRIORITY = "(c_custkey * 7919 + 104729) % 1000003"


@query(f"SELECT c_custkey, {PRIORITY} AS priority FROM customer ORDER BY priority, c_custkey LIMIT 100")
def priority_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.priority_sample(table(spark, sf_dir, "customer").select("c_custkey"), F.expr(PRIORITY), 100, "c_custkey")


@query("WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) SELECT c_custkey FROM k WHERE (k - 1) % 17 = 0")
def grid_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.grid_sample(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 17)


@query("""
    WITH s AS (SELECT o_custkey, o_orderkey, o_orderpriority = '1-URGENT' AS pos, (o_orderkey * 7919) % 1000003 AS pr FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, pos ORDER BY pr, o_orderkey) AS k, count(*) FILTER (pos) OVER (PARTITION BY o_custkey) AS np FROM s)
    SELECT o_custkey, o_orderkey FROM k WHERE CASE WHEN pos THEN k <= least(np, 2) ELSE k <= 8 - least(np, 2) END
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    priority = F.struct((F.col("o_orderkey") * 7919) % 1000003, "o_orderkey")
    return sampling.stratified(rows, F.col("o_orderpriority") == "1-URGENT", 8, 0.25, priority, ["o_custkey"]).select("o_custkey", "o_orderkey")


CATEGORY = "concat(l_returnflag, l_linestatus)"
FACTORS = f"""
    i AS (SELECT DISTINCT l_orderkey, {CATEGORY} AS category FROM lineitem), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem),
    f AS (SELECT category, count(*) AS images, count(*) / (SELECT n FROM n) AS frequency FROM i GROUP BY ALL), w AS (SELECT category, images, frequency, greatest(1.0, sqrt(0.9 / frequency)) AS factor FROM f)
"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(CATEGORY).alias("category"))


@query(f"WITH {FACTORS} SELECT l_orderkey, round(max(factor), 6) AS repeat_factor FROM i JOIN w USING (category) GROUP BY ALL")
def repeat_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.repeat_factors(_images(spark, sf_dir), "l_orderkey", "category", 0.9).select("l_orderkey", r("repeat_factor", 6).alias("repeat_factor"))


@query(f"""
    WITH {FACTORS}, m AS (SELECT l_orderkey, max(factor) AS factor FROM i JOIN w USING (category) GROUP BY ALL), t AS (SELECT l_orderkey, CAST(floor(factor) AS INT) + CASE WHEN ((l_orderkey * 7919) % 1000003) / 1000003 < factor - floor(factor) THEN 1 ELSE 0 END AS times FROM m)
    SELECT l_orderkey, CAST(unnest(range(1, times + 1)) AS INT) AS copy FROM t
""")
def repeated_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.repeat_factors(_images(spark, sf_dir), "l_orderkey", "category", 0.9)
    return sampling.repeated(rows, "repeat_factor", (F.col("l_orderkey") * 7919 % 1000003) / 1000003).select("l_orderkey", "copy")


@query(f"WITH {FACTORS} SELECT category, images, round(frequency, 6) AS frequency, CASE WHEN images <= 10 THEN 'r' WHEN images <= 100 THEN 'c' ELSE 'f' END AS \"group\" FROM f")
def category_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.operators.evaluation import frequency_groups

    return frequency_groups(sampling.category_frequency(_images(spark, sf_dir), "l_orderkey", "category")).select("category", "images", r("frequency", 6).alias("frequency"), "group")


@query("""
    WITH x AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), y AS (SELECT *, n * CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 2.0 ELSE 0.5 END AS w FROM x)
    SELECT o_orderpriority, o_orderstatus, round(w / (SELECT min(w) FROM y), 6) AS weight FROM y
""")
def dataset_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").cast("double").alias("n"))
    return sampling.dataset_weights(rows, "o_orderstatus", "n", {"F": 1.0, "O": 2.0, "P": 0.5}).select("o_orderpriority", "o_orderstatus", r("weight", 6).alias("weight"))


@query("SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS shard FROM orders")
def inference_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shards(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY (o_orderkey * 7919) % 1000003, o_orderkey) - 1) % 4 AS rank FROM orders")
def training_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919) % 1000003).alias("key"))
    return sampling.round_robin(rows, ["key", "o_orderkey"], 4).select("o_orderkey", "rank")


@query("""
    WITH b AS (SELECT o_orderkey, o_custkey > 700 AS bucket, (row_number() OVER (PARTITION BY o_custkey > 700 ORDER BY o_orderkey) - 1) // 8 AS batch FROM orders)
    SELECT bucket, batch, o_orderkey FROM b QUALIFY count(*) OVER (PARTITION BY bucket, batch) = 8
""")
def batch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sampling.grouped_batches(rows, F.col("o_custkey") > 700, ["o_orderkey"], 8).select("bucket", "batch", "o_orderkey")


@query("SELECT n_name, dense_rank() OVER (ORDER BY n_name) - 1 AS dense_id FROM nation")
def category_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.dense_ids(table(spark, sf_dir, "nation"), "n_name")


@query("SELECT s_suppkey, (SELECT count(*) FROM nation n WHERE n.n_nationkey < s.s_nationkey) AS class FROM supplier s")
def annotation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("category_id"))
    return annotations.remap(rows, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))).select("s_suppkey", "class")


@query("SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R')")
def filter_only_crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    objects = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_returnflag") == "R").cast("int").alias("iscrowd"))
    return annotations.only_annotated(images, objects)


@query("SELECT p_brand, count(l_partkey) AS instances FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag <> 'R' GROUP BY ALL")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_part = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(per_part, "p_partkey", "left").groupBy("p_brand").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("instances"))


@query("""
    WITH p AS (SELECT l_orderkey AS image_id, l_extendedprice AS score, l_partkey AS box FROM lineitem), l AS (SELECT image_id, list(box ORDER BY score DESC, box)[1:3] AS boxes FROM p GROUP BY ALL)
    SELECT o_orderkey, CAST(coalesce(len(boxes), 0) AS BIGINT) AS n, boxes[1] AS first FROM orders LEFT JOIN l ON image_id = o_orderkey
""")
def attached_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))
    proposals = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_extendedprice").alias("score"), F.col("l_partkey").alias("box"))
    out = annotations.attach_proposals(images, proposals, 3)
    return out.select(F.col("image_id").alias("o_orderkey"), F.coalesce(big(F.size("proposals")), F.lit(0)).alias("n"), F.try_element_at("proposals", F.lit(1))["box"].alias("first"))


@query("""
    SELECT 'union' AS op, nation FROM (SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 0 UNION SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'intersect', nation FROM (SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
    UNION ALL SELECT 'except', nation FROM (SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda low: table(spark, sf_dir, "customer").where(F.col("c_acctbal") > low).select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier")
    rich = s.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    named = lambda op, df: df.select(F.lit(op).alias("op"), "nation")
    every = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    return named("union", c(0).union(s.select("s_nationkey")).distinct()).unionAll(named("intersect", c(9000).intersect(rich))).unionAll(named("except", every.subtract(rich)))


@query("SELECT l_orderkey, l_linenumber, min(l_suppkey) AS first_writer FROM lineitem GROUP BY ALL")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set insert by key: the smallest writer is the first, whatever order rows come in."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("first_writer"))


@query("SELECT p_partkey, 1 + (row_number() OVER (ORDER BY p_partkey) - 1) // 299 AS sheet FROM part")
def sheet_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.sources.sinks import sheets

    return sheets(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], 300)
