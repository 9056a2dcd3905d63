"""Quantification: lineitem rows stand for pixels, suppliers for cells, return flags for channels, line states for compartments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.operators import joins, phenotype, quantify
from tesserae.plans.registry import big, query, r, table
from tesserae.session import at_most

CELL, CHANNEL, VALUE, LEVEL = "l_suppkey", "l_returnflag", "l_extendedprice", 30000.0
CHANNELS = ["A", "N", "R"]

PARTS = f"""
    SELECT {CELL}, {CHANNEL}, count({VALUE}) AS n, sum({VALUE}) AS total, sum({VALUE} * {VALUE}) AS total_sq, min({VALUE}) AS low, max({VALUE}) AS high,
           count(*) FILTER ({VALUE} > {LEVEL}) AS n_positive
    FROM lineitem GROUP BY ALL
"""
MEASURED = f"""
    SELECT {CELL}, {CHANNEL}, round(total / n, 4) AS mean, round(total, 4) AS sum, high AS max, low AS min,
           round(sqrt(greatest(0.0, total_sq / n - (total / n) * (total / n))), 3) AS std, round(n_positive / n, 6) AS positive_fraction
    FROM parts
"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quantify.metrics(quantify.partials(_pixels(spark, sf_dir), [CELL, CHANNEL], VALUE, LEVEL))
    return out.select(CELL, CHANNEL, r("mean").alias("mean"), r("sum").alias("sum"), "max", "min", r("std", 3).alias("std"), r("positive_fraction", 6).alias("positive_fraction"))


@query(f"WITH parts AS ({PARTS}) {MEASURED}")
def marker_quantification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir)


_cells = ", ".join(f"max(CASE WHEN {CHANNEL} = '{c}' THEN {m} END) AS {c}__{m}" for c in CHANNELS for m in quantify.METRICS)


@query(f"WITH parts AS ({PARTS}), m AS ({MEASURED}) SELECT {CELL}, {_cells} FROM m GROUP BY {CELL}")
def marker_wide_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantify.wide(_measured(spark, sf_dir), CELL, CHANNEL, CHANNELS)


@query("""
    SELECT l_suppkey, l_returnflag, round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 6) AS "F_mean", round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 6) AS "O_mean"
    FROM lineitem GROUP BY ALL
""")
def compartment_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quantify.compartment_means(_pixels(spark, sf_dir), [CELL, CHANNEL], "l_quantity", "l_linestatus", ["F", "O"])
    return out.select(CELL, CHANNEL, r("F_mean", 6).alias("F_mean"), r("O_mean", 6).alias("O_mean"))


@query("SELECT l_suppkey, count(*) FILTER (l_linestatus = 'F') AS \"F_area\", count(*) FILTER (l_linestatus = 'O') AS \"O_area\" FROM lineitem GROUP BY ALL")
def compartment_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantify.areas(_pixels(spark, sf_dir), CELL, "l_linestatus", ["F", "O"])


@query("""
    WITH b AS (SELECT l_returnflag, avg(l_extendedprice) AS bg FROM lineitem WHERE l_discount = 0 GROUP BY ALL),
    m AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS mean FROM lineitem WHERE l_discount <> 0 GROUP BY ALL)
    SELECT l_suppkey, l_returnflag, round(mean, 4) AS mean, round(mean - bg, 4) AS corrected_mean FROM m LEFT JOIN b USING (l_returnflag)
""")
def background_corrected_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _pixels(spark, sf_dir)
    bg = quantify.background(pixels, CHANNEL, VALUE, F.col("l_discount") == 0)
    parts = quantify.partials(pixels.where("l_discount <> 0"), [CELL, CHANNEL], VALUE, LEVEL).join(F.broadcast(bg) if at_most(bg) else bg, CHANNEL, "left")
    return quantify.metrics(parts, F.col("background_mean")).select(CELL, CHANNEL, r("mean").alias("mean"), r("corrected_mean").alias("corrected_mean"))


@query("""
    WITH c AS (SELECT * FROM (VALUES ('A'), ('N'), ('R'), ('X')) t(l_returnflag))
    SELECT l_returnflag, round(avg(l_extendedprice), 4) AS background_mean, count(l_extendedprice) AS background_pixels
    FROM c LEFT JOIN (SELECT * FROM lineitem WHERE l_discount = 0) USING (l_returnflag) GROUP BY ALL
""")
def background_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = spark.createDataFrame([(c,) for c in [*CHANNELS, "X"]], "l_returnflag string")
    out = quantify.background_table(channels, quantify.background(_pixels(spark, sf_dir), CHANNEL, VALUE, F.col("l_discount") == 0), CHANNEL)
    return out.select(CHANNEL, r("background_mean").alias("background_mean"), "background_pixels")


@query(f"SELECT {CELL}, {CHANNEL}, n, round(total, 4) AS total, low, high, n_positive FROM ({PARTS})")
def partial_final_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials by line number, as chunks would leave them, merged."""
    parts = quantify.partials(_pixels(spark, sf_dir), [CELL, CHANNEL, "l_linenumber"], VALUE, LEVEL)
    return quantify.merge(parts.drop("l_linenumber"), [CELL, CHANNEL]).select(CELL, CHANNEL, "n", r("total").alias("total"), "low", "high", "n_positive")


@query("""
    WITH a AS (SELECT l_partkey AS p_partkey, count(*) AS area FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
    m AS (SELECT l_partkey AS p_partkey, round(avg(l_quantity), 6) AS mean_quantity, max(l_extendedprice) AS max_price FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT p_partkey, p_name, coalesce(area, 0) AS area, mean_quantity, max_price FROM part LEFT JOIN a USING (p_partkey) LEFT JOIN m USING (p_partkey)
""")
def export_left_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pixels(spark, sf_dir).withColumnRenamed("l_partkey", "p_partkey")
    areas = rows.where("l_linestatus = 'F'").groupBy("p_partkey").agg(F.count("*").alias("area"))
    measured = rows.where("l_returnflag = 'R'").groupBy("p_partkey").agg(r(F.avg("l_quantity"), 6).alias("mean_quantity"), F.max("l_extendedprice").alias("max_price"))
    return quantify.export(table(spark, sf_dir, "part").select("p_partkey", "p_name"), areas, measured, "p_partkey")


@query("""
    SELECT status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('none')) t(status) LEFT JOIN orders ON o_orderstatus = status GROUP BY ALL
""")
def status_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantify.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "none"])


@query("""
    SELECT coalesce(nullif(trim(CASE WHEN value < 0.2 THEN ' ' ELSE event_type END), ''), 'unknown error') AS error, count(*) AS n
    FROM events GROUP BY ALL ORDER BY n DESC, error LIMIT 5
""")
def error_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("said", F.when(F.col("value") < 0.2, " ").otherwise(F.col("event_type")))
    return quantify.error_groups(rows, "said", 5)


@query("""
    SELECT s_suppkey, channel_start, least(channel_start + 8, 21) AS channel_stop FROM supplier, (SELECT unnest([0, 8, 16]) AS channel_start)
""")
def unit_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantify.unit_queue(table(spark, sf_dir, "supplier").select("s_suppkey"), 21, 8)


@query("""
    WITH c AS (SELECT p_partkey, coalesce(nullif(trim(regexp_replace(split_part(p_name, ' ', 1), '\\s+', ' ', 'g')), ''), 'channel') AS clean FROM part)
    SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY lower(clean) ORDER BY p_partkey) > 1 THEN clean || ' [' || p_partkey || ']' ELSE clean END AS label FROM c
""")
def channel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))
    return quantify.channel_labels(rows, "name", "p_partkey").select("p_partkey", "label")


@query("""
    SELECT l_partkey, count(*) AS area, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY ALL
    HAVING count(*) BETWEEN 20 AND 40 AND avg(l_extendedprice) > 30000
""")
def object_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pixels(spark, sf_dir).groupBy("l_partkey").agg(F.count("*").alias("area"), F.avg(VALUE).alias("_mean"))
    return rows.where("area between 20 and 40 and _mean > 30000").select("l_partkey", "area", r("_mean").alias("mean"))


FEATURES = ["acctbal", "price", "size"]
_FEATURES_SQL = """
    f AS (SELECT p_partkey AS id, CAST(p_retailprice AS DOUBLE) AS price, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE CAST(p_retailprice * p_size AS DOUBLE) END AS acctbal FROM part),
    t AS (SELECT id, asinh(price / 5) AS price, asinh(size / 5) AS size, asinh(acctbal / 5) AS acctbal FROM f),
    m AS (SELECT quantile_cont(price, 0.5) AS price, quantile_cont(size, 0.5) AS size, quantile_cont(acctbal, 0.5) AS acctbal FROM t),
    i AS (SELECT id, coalesce(t.price, m.price) AS price, coalesce(t.size, m.size) AS size, coalesce(t.acctbal, m.acctbal) AS acctbal FROM t, m),
    b AS (SELECT quantile_cont(price, 0.005) AS p0, quantile_cont(price, 0.995) AS p1, quantile_cont(size, 0.005) AS s0, quantile_cont(size, 0.995) AS s1, quantile_cont(acctbal, 0.005) AS a0, quantile_cont(acctbal, 0.995) AS a1 FROM i),
    c AS (SELECT id, least(greatest(price, p0), p1) AS price, least(greatest(size, s0), s1) AS size, least(greatest(acctbal, a0), a1) AS acctbal FROM i, b),
    z AS (SELECT avg(price) AS pm, stddev_pop(price) AS ps, avg(size) AS sm, stddev_pop(size) AS ss, avg(acctbal) AS am, stddev_pop(acctbal) AS az FROM c)
"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("p_retailprice").cast("double"), F.col("p_size").cast("double")
    gap = F.when(F.col("p_partkey") % 50 != 0, F.col("p_retailprice") * F.col("p_size")).cast("double")
    return phenotype.transformed(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), price.alias("price"), size.alias("size"), gap.alias("acctbal")), FEATURES, "arcsinh")


@query(f"WITH {_FEATURES_SQL} SELECT id, round((price - pm) / ps, 6) AS price, round((size - sm) / ss, 6) AS size, round((acctbal - am) / az, 6) AS acctbal FROM c, z")
def feature_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir)
    out = phenotype.apply(rows, FEATURES, phenotype.fit(rows, FEATURES))
    return out.select("id", *[r(f, 6).alias(f) for f in FEATURES])


@query(f"""
    WITH {_FEATURES_SQL}
    SELECT 'price' AS feature, round(m.price, 6) AS median, round(p0, 6) AS winsor_low, round(p1, 6) AS winsor_high, round(pm, 6) AS mean, round(ps, 6) AS std FROM m, b, z
    UNION ALL SELECT 'size', round(m.size, 6), round(s0, 6), round(s1, 6), round(sm, 6), round(ss, 6) FROM m, b, z
    UNION ALL SELECT 'acctbal', round(m.acctbal, 6), round(a0, 6), round(a1, 6), round(am, 6), round(az, 6) FROM m, b, z
""")
def preprocessing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phenotype.fit(_features(spark, sf_dir), FEATURES).select("feature", *[r(c, 6).alias(c) for c in ("median", "winsor_low", "winsor_high", "mean", "std")])


@query("""
    SELECT s_suppkey, feature, value FROM (
        SELECT s_suppkey, 'acctbal' AS feature, CAST(s_acctbal AS DOUBLE) AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier)
""")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("acctbal"), F.col("s_nationkey").cast("double").alias("nation"))
    return phenotype.long_report(rows, "s_suppkey", ["acctbal", "nation"])


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    parts = rows.select("label", F.posexplode("vector").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("v"))
    centroids = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("vector"))
    return rows, centroids


_NEAREST = """
    e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings),
    c AS (SELECT label, k, avg(v) AS v FROM e GROUP BY ALL),
    d AS (SELECT e.vec_id, c.label, sum((e.v - c.v) * (e.v - c.v)) AS d2 FROM e JOIN c USING (k) GROUP BY ALL),
    near AS (SELECT vec_id, arg_min(label, (d2, label)) AS label, min(d2) AS d2 FROM d GROUP BY ALL)
"""


@query(f"WITH {_NEAREST} SELECT vec_id, label, round(d2, 5) AS d2 FROM near")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.operators.joins import nearest_centroid as join

    rows, centroids = _vectors(spark, sf_dir)
    return join(rows, centroids, "vec_id").select("vec_id", "label", r("d2", 5).alias("d2"))


@query(f"""
    WITH {_NEAREST}, l AS (SELECT DISTINCT label FROM embeddings UNION SELECT 99)
    SELECT CAST(l.label AS BIGINT) AS cluster_id, count(near.vec_id) AS cell_count, round(count(near.vec_id) / (SELECT count(*) FROM near), 6) AS fraction
    FROM l LEFT JOIN near ON l.label = near.label GROUP BY ALL
""")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.operators.joins import nearest_centroid as join

    rows, centroids = _vectors(spark, sf_dir)
    known = centroids.select(big("label").alias("cluster_id")).unionAll(spark.range(99, 100).select(F.col("id").alias("cluster_id")))
    out = phenotype.summary(join(rows, centroids, "vec_id").select(big("label").alias("cluster_id")), known)
    return out.select("cluster_id", "cell_count", r("fraction", 6).alias("fraction"))


@query("""
    SELECT vec_id, CAST(label AS BIGINT) AS cluster_id, CASE label WHEN 1 THEN 'Tumour' WHEN 3 THEN 'Stroma' ELSE 'Cluster ' || label END AS cluster_name FROM embeddings
""")
def rename_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", big("label").alias("cluster_id")).withColumn("cluster_name", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")))
    names = spark.createDataFrame([(1, " Tumour "), (2, "  "), (3, "Stroma")], "cluster_id long, new_name string")
    return phenotype.rename(rows, names)


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the standardized features; signs are fixed by the largest weight."""
    rows = _features(spark, sf_dir)
    ready = phenotype.apply(rows, FEATURES, phenotype.fit(rows, FEATURES))
    mean, axes, _ = phenotype.pca(ready, FEATURES, 2)
    return ready.select("id", *phenotype.project(FEATURES, mean, axes))


@query()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir)
    ready = phenotype.apply(rows, FEATURES, phenotype.fit(rows, FEATURES))
    centroids = phenotype.kmeans(ready.select(F.array(*FEATURES).alias("vector")), "vector", 5)
    return phenotype.summary(phenotype.assign(ready, FEATURES, centroids, "id"))


@query("""
    WITH f AS (SELECT p_partkey AS id, CAST(p_retailprice AS DOUBLE) / 100 AS a, CAST(p_size AS DOUBLE) AS b FROM part),
    m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(a * a) - avg(a) * avg(a) AS va, avg(b * b) - avg(b) * avg(b) AS vb, avg(a * b) - avg(a) * avg(b) AS c FROM f),
    e AS (SELECT *, (va + vb) / 2 + sqrt(((va - vb) / 2) * ((va - vb) / 2) + c * c) AS top FROM m),
    -- the first direction is (c, top - va) or (top - vb, c), whichever is longer; the second is at a right angle
    d AS (SELECT *, CASE WHEN abs(top - vb) > abs(top - va) THEN top - vb ELSE c END AS u, CASE WHEN abs(top - vb) > abs(top - va) THEN c ELSE top - va END AS v FROM e),
    n AS (SELECT ma, mb, u / sqrt(u * u + v * v) AS u, v / sqrt(u * u + v * v) AS v FROM d),
    s AS (SELECT ma, mb, CASE WHEN abs(u) >= abs(v) THEN sign(u) ELSE sign(v) END * u AS u1, CASE WHEN abs(u) >= abs(v) THEN sign(u) ELSE sign(v) END * v AS v1, CASE WHEN abs(v) >= abs(u) THEN sign(-v) ELSE sign(u) END * (-v) AS u2, CASE WHEN abs(v) >= abs(u) THEN sign(-v) ELSE sign(u) END * u AS v2 FROM n)
    SELECT id, round((a - ma) * u1 + (b - mb) * v1, 4) AS pca1, round((a - ma) * u2 + (b - mb) * v2, 4) AS pca2 FROM f, s
""")
def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two features, whose directions SQL can say in closed form."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice").cast("double") / 100).alias("a"), F.col("p_size").cast("double").alias("b"))
    mean, axes, _ = phenotype.pca(rows, ["a", "b"], 2)
    return rows.select("id", *phenotype.project(["a", "b"], mean, axes)).select("id", r("pca1").alias("pca1"), r("pca2").alias("pca2"))


@query("""
    SELECT count(*) AS cell_count, round(avg(1000 * (p_partkey % 3) + p_size), 4) AS x, round(avg(500 * (p_partkey % 3) - p_size), 4) AS y FROM part GROUP BY p_partkey % 3
""")
def kmeans_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups far apart: whatever it starts from, k-means finds their means."""
    k = F.col("p_partkey") % 3
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array((1000 * k + F.col("p_size")).cast("double"), (500 * k - F.col("p_size")).cast("double")).alias("vector"))
    centroids = phenotype.kmeans(rows, "vector", 3)
    found = joins.nearest_centroid(rows, centroids).groupBy("label").agg(F.count("*").alias("cell_count"))
    return found.join(centroids, "label").select("cell_count", r(F.col("vector")[0]).alias("x"), r(F.col("vector")[1]).alias("y"))
