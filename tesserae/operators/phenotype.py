"""Feature preprocessing, principal components, clustering, assignment and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tesserae.functions.scalar import arcsinh, clip, finite, impute, signed_log1p, zscore
from tesserae.operators.joins import nearest_centroid
from tesserae.session import at_most, ready

TRANSFORMS = {"none": lambda c: F.col(c).cast("double"), "arcsinh": lambda c: arcsinh(F.col(c).cast("double")), "log1p": lambda c: signed_log1p(F.col(c).cast("double"))}


def transformed(df: DataFrame, features: list[str], how: str = "none") -> DataFrame:
    if how not in TRANSFORMS:
        raise ValueError(f"transform must be one of {', '.join(TRANSFORMS)}")
    return df.withColumns({f: TRANSFORMS[how](f) for f in features})


def sample(df: DataFrame, key: str, size: int, seed: int = 13) -> DataFrame:
    """The rows with the smallest seeded hashes: the same ones however the rows are dealt."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(size)


def fit(df: DataFrame, features: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """feature, median, winsor_low, winsor_high, mean, std: median of finite values, then exact percentiles with the gaps filled,
    then moments of what is clipped. Three passes of one aggregate each over all features together."""
    medians = df.agg(*[F.percentile(F.when(finite(f), F.col(f)), 0.5).alias(f) for f in features]).first()
    filled = df.select(*[impute(f, 0.0 if medians[f] is None else medians[f]).alias(f) for f in features])
    ends = filled.agg(*[F.percentile(f, F.array(F.lit(low), F.lit(high))).alias(f) for f in features]).first()
    clipped = filled.select(*[clip(f, *ends[f]).alias(f) if ends[f] else F.col(f) for f in features])
    moments = clipped.agg(*[F.avg(f).alias(f"{f}_m") for f in features], *[F.stddev_pop(f).alias(f"{f}_s") for f in features]).first()
    rows = [(f, medians[f], *(ends[f] or (None, None)), moments[f"{f}_m"], moments[f"{f}_s"]) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, median double, winsor_low double, winsor_high double, mean double, std double")


def apply(df: DataFrame, features: list[str], report: DataFrame) -> DataFrame:
    """df with its features filled, clipped and standardized by a report of fit(), one row a feature, as literals."""
    stats = {r["feature"]: r for r in report.collect()}
    return df.withColumns({f: zscore(clip(impute(f, s["median"]), s["winsor_low"], s["winsor_high"]), s["mean"], s["std"]) for f, s in stats.items() if f in features})


def pca(df: DataFrame, features: list[str], components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, directions (rows) and variances from sums of products: one pass, a matrix of features squared on the driver."""

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, np.zeros(len(features)), np.zeros((len(features), len(features)))
        for b in batches:
            v = b.to_numpy(np.float64)
            n, s, g = n + len(v), s + v.sum(axis=0), g + v.T @ v
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    ready(df.sparkSession)
    # one row a partition; element-wise sums leave one row
    parts = df.select(*[F.col(f).cast("double") for f in features]).mapInPandas(gram, "n long, s array<double>, g array<double>")
    flat = parts.select("n", F.posexplode(F.concat("s", "g")).alias("k", "v"))
    sums = {r["k"]: r["v"] for r in flat.groupBy("k").agg(F.sum("v").alias("v")).collect()}
    n = parts.agg(F.sum("n")).first()[0] or 0
    p = len(features)
    if not n:
        raise ValueError("no rows")
    mean = np.array([sums[k] for k in range(p)]) / n
    cov = np.array([sums[p + k] for k in range(p * p)]).reshape(p, p) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[: max(1, min(components, p, n - 1))]
    rows = vectors[:, order].T
    rows *= np.where(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)] < 0, -1, 1)[:, None]  # a sign to rely on
    return mean, rows, np.maximum(values[order], 0)


def project(features: list[str], mean: np.ndarray, rows: np.ndarray) -> list[Column]:
    """The scores as unrolled sums of products, within whole-stage code."""
    out = []
    for k, row in enumerate(rows):
        score = F.lit(0.0)
        for f, m, w in zip(features, mean.tolist(), row.tolist(), strict=True):
            score = score + (F.col(f) - m) * w
        out.append(score.alias(f"pca{k + 1}"))
    return out


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 13, rounds: int = 50) -> DataFrame:
    """label and vector of k centroids, by the library's parallel k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_v").fit(df.select(array_to_vector(F.col(vector)).alias("_v")))
    return df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "label int, vector array<double>")


def knn_weights(neighbours: DataFrame) -> DataFrame:
    """a < b and weight 1 / (1 + distance), the larger of the two directions."""
    return neighbours.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(1 / (1 + F.col("distance"))).alias("weight"))


def communities(edges: list[tuple[int, int, float]], nodes: list[int], resolution: float = 1.0, seed: int = 13) -> dict[int, int]:
    """Modularity communities of a graph of sampled nodes, which is bounded by the sample: local moves, then the same on the graph of
    communities until nothing moves; a community that falls apart is split. Labels from 0 by first node."""
    rng = np.random.default_rng(seed)
    member = {n: n for n in nodes}
    graph: dict[int, dict[int, float]] = {n: {} for n in nodes}
    for a, b, w in edges:
        if a != b:
            graph[a][b] = graph[a].get(b, 0.0) + w
            graph[b][a] = graph[b].get(a, 0.0) + w
    loops = dict.fromkeys(nodes, 0.0)
    total = sum(sum(x.values()) for x in graph.values()) / 2 or 1.0
    while True:
        degree = {n: sum(graph[n].values()) + 2 * loops[n] for n in graph}
        home = {n: n for n in graph}
        weight = dict(degree)
        moved, again = False, True
        while again:
            again = False
            order = list(graph)
            rng.shuffle(order)
            for n in order:
                links: dict[int, float] = {}
                for m, w in graph[n].items():
                    links[home[m]] = links.get(home[m], 0.0) + w
                old = home[n]
                weight[old] -= degree[n]
                gain = lambda c: links.get(c, 0.0) - resolution * weight[c] * degree[n] / (2 * total)  # noqa: B023, E731
                best = max(sorted({old, *links}), key=lambda c: (gain(c), c == old))
                if gain(best) <= gain(old) + 1e-12:
                    best = old
                weight[best] += degree[n]
                if best != old:
                    home[n], again, moved = best, True, True
        if not moved:
            break
        member = {n: home[c] for n, c in member.items()}
        joined: dict[int, dict[int, float]] = {c: {} for c in set(home.values())}
        inner = dict.fromkeys(joined, 0.0)
        for n, near in graph.items():
            inner[home[n]] += loops[n]
            for m, w in near.items():
                if home[n] == home[m]:
                    inner[home[n]] += w / 2
                else:
                    joined[home[n]][home[m]] = joined[home[n]].get(home[m], 0.0) + w
        graph, loops = joined, inner
    number: dict[int, int] = {}
    return {n: number.setdefault(member[n], len(number)) for n in nodes}


def assign(cells: DataFrame, features: list[str], centroids: DataFrame, key: str) -> DataFrame:
    """cells with cluster_id (from 1) and cluster_name by nearest centroid of the standardized features."""
    vectors = cells.select(F.col(key), F.array(*features).alias("vector"))
    found = nearest_centroid(vectors, centroids, key).select(key, (F.col("label") + 1).alias("cluster_id"))
    return cells.join(found, key).withColumn("cluster_name", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")))


def summary(assigned: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """cluster_id, count and fraction of all rows, empty clusters with 0."""
    counts = assigned.groupBy("cluster_id").agg(F.count("*").alias("cell_count"))
    total = assigned.agg(F.count("*").alias("_total"))
    out = counts if clusters is None else clusters.select("cluster_id").join(counts, "cluster_id", "left").withColumn("cell_count", F.coalesce("cell_count", F.lit(0).cast("long")))
    n = total.first()[0]
    return out.withColumn("fraction", F.try_divide(F.col("cell_count").cast("double"), F.lit(float(n))))


def rename(assigned: DataFrame, names: DataFrame) -> DataFrame:
    """cluster_name replaced by names (cluster_id, new_name); blank names are ignored."""
    given = names.select("cluster_id", F.nullif(F.trim("new_name"), F.lit("")).alias("_new"))
    given = F.broadcast(given) if at_most(given) else given
    return assigned.join(given, "cluster_id", "left").withColumn("cluster_name", F.coalesce("_new", "cluster_name")).drop("_new")


def features_json(features: list[str]) -> Column:
    """Finite features as one object with keys in order; others are null."""
    return F.to_json(F.struct(*[F.when(finite(f), F.col(f)).alias(f) for f in sorted(features)]), {"ignoreNullFields": "false"})


def long_report(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """key, feature, value rows of a wide table."""
    return df.unpivot([key], features, "feature", "value")
