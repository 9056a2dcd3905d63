"""Connected components of a link table by rounds of large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tesserae.session import BROADCAST_ROWS, dealt, ready, written

#: Links that one task may hold; they are pairs of numbers.
ONE_TASK = BROADCAST_ROWS


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (the smallest node reached) of every node with a link to another one.

    A round ties each node's larger, then its smaller, neighbours to the smallest one it knows; links never grow in number and the
    rounds grow with the logarithm of the nodes. Each round is written to the shared folder, so lineage stays short and a lost
    executor costs one round at most. What is left of links, once they are ONE_TASK or fewer, is finished by one task at once.
    """
    now = written(links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "links")
    mark = _mark(now)
    while mark[0] > ONE_TASK:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(dealt(low), "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct(), "large")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(dealt(least), "v").select(F.col("m").alias("u"), F.col("u").alias("v")).where("u <> v").unionAll(least.select(F.col("m").alias("u"), "v"))
        after = written(small.distinct(), "small")
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            roots = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(roots)
    return _finished(now)


def _finished(links: DataFrame) -> DataFrame:
    """The components of ONE_TASK links at most, by union and find."""
    kind = links.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        values = pa.int64()
        for b in batches:
            values = b.column(0).type
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, v = root(u), root(v)
                up[max(u, v)] = min(u, v)
        nodes = [*up]
        for k in range(0, len(nodes), 10_000):
            part = nodes[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, values), pa.array([root(x) for x in part], values)], ["node", "component"])

    ready(links.sparkSession)
    schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])
    return links.select("u", "v").coalesce(1).mapInArrow(run, schema)


def _mark(links: DataFrame) -> tuple:
    """Tells sets of links apart: their number and two sums of hashes."""
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
