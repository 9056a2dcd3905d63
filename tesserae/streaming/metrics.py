"""Scalar time series: latest values, windowed medians, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(rows: DataFrame, name: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(name).agg(F.max_by(value, order).alias("value"), F.max(order).alias("at"))


def windowed_median(rows: DataFrame, name: str, value: str, order: str, size: int, blocks: int = 32) -> DataFrame:
    """Median and number of each series' values whose order is within the last `size` before and at each row.

    A series may be long, so it is cut into blocks of `blocks` windows; a row that a later block's windows reach goes there as well."""
    width = size * blocks
    own, last = F.floor(F.col(order) / width), F.floor((F.col(order) + size - 1) / width)
    dealt = rows.withColumn("_block", F.explode(F.sequence(own, last))).withColumn("_own", F.col("_block") == own)
    w = Window.partitionBy(name, "_block").orderBy(order).rangeBetween(-(size - 1), 0)
    out = dealt.withColumn("median", F.percentile(value, F.lit(0.5)).over(w)).withColumn("samples", F.count(value).over(w))
    return out.where("_own").drop("_block", "_own")


def last_median(rows: DataFrame, name: str, value: str, order: str, size: int) -> DataFrame:
    """The same for the last row of each series only: one aggregate after a join with the series' ends."""
    ends = rows.groupBy(name).agg(F.max(order).alias("_end"))
    near = rows.join(ends, name).where(F.col(order) > F.col("_end") - size)
    return near.groupBy(name).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.count(value).alias("samples"))


def histogram(rows: DataFrame, name: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """name, bin (0 ..; the top edge belongs to the last), n, sum and sum of squares."""
    v = F.col(value).cast("double")
    raw = F.floor((v - low) / ((high - low) / bins))
    bin_: Column = F.when(v == high, bins - 1).otherwise(raw)
    return rows.where((v >= low) & (v <= high)).groupBy(name, bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("total_sq"))


def timing_percentiles(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.01, 0.05, 0.95, 0.99)) -> DataFrame:
    """Observed values at these shares."""
    return rows.agg(*[F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY {value})").alias(f"p{int(s * 100)}") for s in shares])
