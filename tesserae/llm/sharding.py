"""Two-pass external shuffle: records scattered into memory-sized buckets, each bucket shuffled by Fisher-Yates and written.

The law is `rows`: shards' row counts are at most one apart. The buckets, in order, are one random permutation of all records;
the record at place p goes to shard p mod n, slot p div n. DataFrame functions only; Spark's shuffle() of an array is Fisher-Yates.

Buckets hold `bucket_bytes` of text on average, whatever their number; where there would be more than MOST_PARTITIONS, up to BUCKETS_EACH
of them share a partition, and beyond that they grow. A bucket's number comes from a seeded hash of the whole record, so that
copies and null ids spread as evenly as others. Records that are equal in every column are numbered among themselves and spread by their
numbers. The order follows from the seed and the records alone, not from how they were read.

Defined results: a null text has no bytes and counts 8 for its row; an empty table gives no rows; columns named as the results
(shard, slot, bucket) are replaced, all others are kept, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tesserae.llm.common import at_most, fresh_dir, written

OWN = ("shard", "slot", "bucket")
MOST_PARTITIONS = 50_000
BUCKETS_EACH = 16
#: Equal records that one task numbers.
_RUN = 10_000


def _size(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")


def _hashed(rows: DataFrame, seed: int) -> DataFrame:
    """rows (one column, `_row`) with `_h`, a seeded hash that differs even among equal records."""
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "_row"))
    repeated = written(rows.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h"), "repeated")
    if at_most(repeated, 0):
        return rows
    small = F.broadcast(repeated) if at_most(repeated) else repeated
    # equal records come down to one and a count, and are made again in runs
    groups = rows.join(small, "_h", "left_semi").groupBy("_h", "_row").agg(F.count("*").alias("_n"))
    runs = groups.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _RUN)))).repartition("_h", "_k")
    each = F.explode(F.sequence(F.col("_k") * _RUN, F.least(F.col("_n"), (F.col("_k") + 1) * _RUN) - 1))
    many = runs.withColumn("_k", each).select("_row", F.when(F.col("_n") > 1, F.xxhash64("_h", "_k")).otherwise(F.col("_h")).alias("_h"))
    return rows.join(small, "_h", "left_anti").select("_row", "_h").unionAll(many)


def external_shuffle(df: DataFrame, path: str, shards: int, seed: int = 17, bucket_bytes: int = 16 << 20, text: str = "text") -> DataFrame:
    """Write df's records shuffled under path, with bucket, shard and slot; return what was written.

    Files of one bucket hold its records in shuffled order; a shard's are those with its number, by slot.
    """
    kept = [c for c in df.columns if c.lower() not in OWN]
    taken = {c.lower() for c in df.columns}
    at, start = (next(x for k in range(len(taken) + 1) if (x := name + "_" * k) not in taken) for name in ("at", "start"))
    total = df.agg(F.sum(_size(text) + 64)).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    each = min(BUCKETS_EACH, -(-n // MOST_PARTITIONS))
    n_parts = -(-n // each)
    tagged = _hashed(df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")), seed)
    # pass 1: scatter. Each bucket is one array, in an order that doesn't depend on how its records arrive.
    bucket = F.pmod("_h", F.lit(n)).cast("int")
    first = tagged.select(bucket.alias("bucket"), F.floor(bucket / each).cast("int").alias("_part"), F.struct("_h", "_row").alias("_r")).repartitionById(n_parts, F.col("_part"))
    buckets = first.groupBy("_part", "bucket").agg(F.sort_array(F.collect_list("_r")).alias("_r"))
    if each > 1:  # shuffle() draws its numbers in the order of the rows
        buckets = buckets.sortWithinPartitions("bucket")
    # pass 2: shuffle each bucket
    dealt = buckets.select("bucket", F.posexplode(F.shuffle("_r", seed)).alias("_at", "_r")).select("bucket", "_at", F.col("_r._row").alias("_row"))
    shuffled = dealt.select("bucket", F.col("_at").alias(at), *[F.col("_row").getField(c).alias(c) for c in kept])
    shuffled.write.parquet(path)
    out = df.sparkSession.read.schema(shuffled.schema).parquet(path)
    # a bucket's first place is the number of records before it: one row a bucket
    counts = out.groupBy("bucket").agg(F.count("*").alias("_n"))
    starts = written(counts.select("bucket", (F.sum("_n").over(Window.orderBy("bucket")) - F.col("_n")).alias(start)), "starts")
    place = F.col(start) + F.col(at)
    return out.join(starts, "bucket").select(*[F.col(f"`{c}`") for c in kept], "bucket", (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def report(docs: DataFrame, shards: int = 24, **how) -> DataFrame:
    """Where each record went, its size and checksum, read from what was written."""
    out = external_shuffle(docs, fresh_dir(docs.sparkSession, "shards"), shards, **how)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return out.select("doc_id", (_size("text") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
