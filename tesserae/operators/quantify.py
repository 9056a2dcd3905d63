"""Per-object, per-channel measurement: additive partials, merge, derived metrics, compartments, background, wide tables, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tesserae.session import at_most

#: Additive or idempotent partial aggregates; MERGE says how two of them combine.
MERGE = {"n": F.sum, "total": F.sum, "total_sq": F.sum, "low": F.min, "high": F.max, "n_positive": F.sum}
METRICS = ("mean", "sum", "max", "min", "std", "positive_fraction")


def partials(pixels: DataFrame, keys: list[str], value: str, threshold: Column | float) -> DataFrame:
    """n, total, total_sq, low, high and n_positive (strictly above the threshold) by keys. Spark sums on the map side first."""
    v = F.col(value).cast("double")
    return pixels.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("total_sq"), F.min(v).alias("low"), F.max(v).alias("high"), F.count_if(v > threshold).alias("n_positive")
    )


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partials of chunks, channel batches or earlier runs combined: sums add, ends combine."""
    return parts.groupBy(*keys).agg(*[f(c).alias(c) for c, f in MERGE.items()])


def metrics(parts: DataFrame, background: Column | None = None) -> DataFrame:
    """mean, sum, max, min, std (of the population, never below 0), positive_fraction and, given a background, the corrected mean."""
    mean = F.try_divide("total", "n")
    out = (
        parts.withColumn("mean", mean)
        .withColumn("sum", F.col("total"))
        .withColumn("max", F.col("high"))
        .withColumn("min", F.col("low"))
        .withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.try_divide("total_sq", "n") - mean * mean)))
        .withColumn("positive_fraction", F.try_divide("n_positive", "n"))
    )
    return out if background is None else out.withColumn("corrected_mean", mean - background)


def compartment_means(pixels: DataFrame, keys: list[str], value: str, compartment: str, names: list[str]) -> DataFrame:
    """One conditional sum and count for each compartment in a single pass; null where a compartment has no pixels."""
    v = F.col(value).cast("double")
    aggs = []
    for n in names:
        inside = F.col(compartment) == n
        aggs += [F.sum(F.when(inside, v)).alias(f"_s_{n}"), F.count(F.when(inside, v)).alias(f"_n_{n}")]
    out = pixels.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[F.try_divide(f"_s_{n}", f"_n_{n}").alias(f"{n}_mean") for n in names])


def areas(labels: DataFrame, cell: str, compartment: str, names: list[str]) -> DataFrame:
    return labels.groupBy(cell).agg(*[F.count_if(F.col(compartment) == n).alias(f"{n}_area") for n in names])


def background(pixels: DataFrame, channel: str, value: str, outside: Column) -> DataFrame:
    """Mean and number of the pixels that belong to no object."""
    return pixels.where(outside).groupBy(channel).agg(F.avg(F.col(value).cast("double")).alias("background_mean"), F.count("*").alias("background_pixels"))


def background_table(channels: DataFrame, backgrounds: DataFrame, channel: str) -> DataFrame:
    """All channels; a channel without background pixels has a null mean and 0 pixels."""
    return channels.join(F.broadcast(backgrounds) if at_most(backgrounds) else backgrounds, channel, "left").withColumn("background_pixels", F.coalesce("background_pixels", F.lit(0).cast("long")))


def wide(measured: DataFrame, key: str, channel: str, channels: list[str], names: tuple[str, ...] = METRICS) -> DataFrame:
    """One row a key, columns `{channel}__{metric}` in the given order of channels; null where a pair was not measured."""
    out = measured.groupBy(key).pivot(channel, channels).agg(*[F.first(m).alias(m) for m in names])
    return out.select(key, *[F.col(f"`{c}_{m}`").alias(f"{c}__{m}") for c in channels for m in names])


def export(cells: DataFrame, areas_: DataFrame, measured: DataFrame, key: str) -> DataFrame:
    """All cells with their areas (0 if absent) and measurements (null if absent); measurements of no cell are dropped."""
    out = cells.join(areas_, key, "left").join(measured, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in areas_.columns if c != key})


def channel_labels(channels: DataFrame, name: str, order: str) -> DataFrame:
    """label: the name without line breaks; a name that came before, whatever its case, gets ` [index]`."""
    from pyspark.sql import Window

    from tesserae.functions.scalar import clean_label

    rows = channels.withColumn("_clean", clean_label(name))
    again = F.row_number().over(Window.partitionBy(F.lower("_clean")).orderBy(order)) > 1
    return rows.withColumn("label", F.when(again, F.concat(F.col("_clean"), F.lit(" ["), F.col(order).cast("string"), F.lit("]"))).otherwise(F.col("_clean"))).drop("_clean")


def feature_columns(columns: list[str], ignore: tuple[str, ...] = ()) -> list[str]:
    """Measured columns by name."""
    return [c for c in columns if "__" in c and c not in ignore]


def default_features(columns: list[str]) -> list[str]:
    """Means but for the nuclear stain; all means if nothing is left."""
    means = [c for c in feature_columns(columns) if c.endswith("__mean")]
    return [c for c in means if "dapi" not in c.lower()] or means


def status_counts(units: DataFrame, status: str, known: list[str]) -> DataFrame:
    """Number of units by status, 0 for a known status without units."""
    spark = units.sparkSession
    every = spark.createDataFrame([(s,) for s in known], "status string")
    counts = units.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return every.join(counts, "status", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def error_groups(units: DataFrame, error: str, limit: int, default: str = "unknown error") -> DataFrame:
    """The most frequent errors, blank and null ones as `default`, ties by text."""
    said = F.coalesce(F.nullif(F.trim(F.col(error)), F.lit("")), F.lit(default))
    return units.groupBy(said.alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(limit)


def unit_queue(tiles: DataFrame, channels: int, batch: int) -> DataFrame:
    """A unit of work for each tile and batch of channels: batches are generated from the tile's row, in order."""
    return tiles.withColumn("channel_start", F.explode(F.sequence(F.lit(0), F.lit(channels - 1), F.lit(batch)))).withColumn(
        "channel_stop", F.least(F.col("channel_start") + batch, F.lit(channels))
    )
