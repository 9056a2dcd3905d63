"""Ranking, numbering, sampling, sharding and batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tesserae.session import at_most, written


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark limits each group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def representative(members: DataFrame, group: str) -> DataFrame:
    """The member that stands for its group: owned first, then not at the read edge, by score, area and the smaller id. One aggregate."""
    best = F.struct(F.col("owned").cast("int").alias("o"), (1 - F.col("at_edge").cast("int")).alias("e"), "score", "area", (-F.col("id")).alias("n"))
    return members.groupBy(group).agg((-F.max(best)["n"]).alias("representative"), F.count("*").alias("source_count"), F.sum(F.col("owned").cast("long")).alias("owned_count"), F.min("id").alias("first_member"))


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df with numbers from 1 in a global order, without one task that sorts all: rows are range-partitioned, and a partition's first
    number is the count of those before it."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))  # one row a partition
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_p").withColumn(name, (F.col("_start") + within).cast("long")).drop("_p", "_start")


def priority_sample(df: DataFrame, priority: Column, k: int, tie: str) -> DataFrame:
    """The k rows of smallest priority."""
    return df.withColumn("priority", priority).orderBy("priority", tie).limit(k)


def ratio_sample(df: DataFrame, key: str, ratio: float, seed: int = 13) -> DataFrame:
    """A seeded sample of int(rows x ratio) rows, the same ones however the rows are dealt."""
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be from 0 to 1")
    return priority_sample(df, F.xxhash64(F.lit(seed), F.col(key)), int(df.count() * ratio), key)


def grid_sample(df: DataFrame, order: str, step: int) -> DataFrame:
    """Each step-th row in order, from the first."""
    return numbered(df, [order], "_k").where((F.col("_k") - 1) % step == 0).drop("_k")


def stratified(df: DataFrame, positive: Column, n: int, fraction: float, priority: Column, group: list[str] | None = None) -> DataFrame:
    """min(positives, int(n x fraction)) positives and negatives up to n, by priority, for each group."""
    group = group or []
    rows = df.withColumn("_pos", positive).withColumn("_pr", priority)
    rank = F.row_number().over(Window.partitionBy(*group, "_pos").orderBy("_pr"))
    counts = rows.groupBy(*group).agg(F.count_if("_pos").alias("_np"))
    ranked = rows.withColumn("_rank", rank).where(F.col("_rank") <= n)
    joined = ranked.join(F.broadcast(counts) if at_most(counts) else counts, group) if group else ranked.withColumn("_np", F.lit(counts.first()[0]))
    take = F.least(F.col("_np"), F.lit(int(n * fraction)))
    return joined.where(F.when(F.col("_pos"), F.col("_rank") <= take).otherwise(F.col("_rank") <= n - take)).drop("_pos", "_pr", "_rank", "_np")


def category_frequency(rows: DataFrame, image: str, category: str) -> DataFrame:
    """Share of the images that hold each category."""
    total = rows.agg(F.count_distinct(image)).first()[0]
    return rows.groupBy(category).agg(F.count_distinct(image).alias("images")).withColumn("frequency", F.try_divide(F.col("images").cast("double"), F.lit(float(total))))


def repeat_factors(rows: DataFrame, image: str, category: str, threshold: float, sqrt: bool = True) -> DataFrame:
    """Each image's largest category factor max(1, (threshold / frequency) ** 1/2)."""
    ratio = threshold / F.col("frequency")
    factors = category_frequency(rows, image, category).select(category, F.greatest(F.lit(1.0), F.sqrt(ratio) if sqrt else ratio).alias("factor"))
    return rows.select(image, category).distinct().join(F.broadcast(factors) if at_most(factors) else factors, category).groupBy(image).agg(F.max("factor").alias("repeat_factor"))


def repeated(df: DataFrame, factor: str, draw: Column) -> DataFrame:
    """Rows repeated floor(factor) times, once more where draw (uniform in 0..1) is below the rest."""
    times = F.floor(factor) + F.when(draw < F.col(factor) - F.floor(factor), 1).otherwise(0)
    return df.withColumn("_t", times.cast("int")).where("_t > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_t")))).drop("_t")


def dataset_weights(factors: DataFrame, dataset: str, factor: str, weights: dict[str, float]) -> DataFrame:
    """Category factor times dataset weight, divided by the smallest product."""
    named = F.element_at(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv]), F.col(dataset))
    rows = factors.withColumn("weight", F.col(factor) * named)
    low = rows.agg(F.min("weight")).first()[0]
    return rows.withColumn("weight", F.col("weight") / F.lit(low))


def shards(df: DataFrame, order: list[str], world: int) -> DataFrame:
    """shard 0 .. world - 1 of contiguous ranges, the first ones a row longer where it doesn't divide."""
    rows = numbered(df, order, "_k")
    n = rows.count()
    size, longer = divmod(n, world)
    k = F.col("_k") - 1
    split = longer * (size + 1)
    shard = F.when(k < split, F.floor(k / (size + 1))).otherwise(longer + F.floor((k - split) / max(size, 1)))
    return rows.withColumn("shard", shard.cast("long")).drop("_k")


def round_robin(df: DataFrame, order: list[str], world: int) -> DataFrame:
    """rank = position mod world."""
    return numbered(df, order, "_k").withColumn("rank", F.pmod(F.col("_k") - 1, F.lit(world)).cast("long")).drop("_k")


def grouped_batches(df: DataFrame, group: Column, order: list[str], size: int) -> DataFrame:
    """batch numbers within each group; a group's last, short batch is dropped."""
    rows = df.withColumn("bucket", group)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*order)) - 1
    out = rows.withColumn("batch", F.floor(rank / size).cast("long"))
    sizes = out.groupBy("bucket", "batch").agg(F.count("*").alias("_n")).where(F.col("_n") == size).drop("_n")
    return out.join(F.broadcast(sizes) if at_most(sizes) else sizes, ["bucket", "batch"])


def dense_ids(df: DataFrame, key: str, name: str = "dense_id") -> DataFrame:
    """key and its contiguous id from 0, in the order of keys."""
    return numbered(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], "_k").select(key, (F.col("_k") - 1).alias(name))


def limited(df: DataFrame, order: list[str], limit: int) -> tuple[DataFrame, bool]:
    """The first rows and whether there are more."""
    more = df.orderBy(*order).limit(limit + 1)
    return more.limit(limit), more.count() > limit
