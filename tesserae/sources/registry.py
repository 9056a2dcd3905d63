"""Named datasets and their metadata: lazy, registered once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Loader = Callable[[SparkSession], DataFrame]


class Metadata(dict):
    """Attributes written once: another value for a name is an error."""

    def put(self, **items) -> Metadata:
        for k, v in items.items():
            if k in self and self[k] != v:
                raise ValueError(f"{k} is set to something else")
            self[k] = v
        return self


class Catalog:
    def __init__(self) -> None:
        self._loaders: dict[str, Loader] = {}
        self._metadata: dict[str, Metadata] = {}

    def register(self, name: str, loader: Loader, **metadata) -> None:
        if name in self._loaders:
            raise ValueError(f"{name} is registered")
        self._loaders[name] = loader
        self.metadata(name).put(**metadata)

    def get(self, spark: SparkSession, name: str, view: bool = False) -> DataFrame:
        if name not in self._loaders:
            raise KeyError(f"no dataset {name}; there are {', '.join(sorted(self._loaders)) or 'none'}")
        df = self._loaders[name](spark)
        if view:
            df.createOrReplaceTempView(name)
        return df

    def metadata(self, name: str) -> Metadata:
        return self._metadata.setdefault(name, Metadata())

    def names(self) -> list[str]:
        return sorted(self._loaders)

    def remove(self, name: str) -> None:
        if name not in self._loaders:
            raise KeyError(f"no dataset {name}")
        del self._loaders[name]
        self._metadata.pop(name, None)

    def register_parquet(self, folder: str, names: list[str], prefix: str = "") -> None:
        """A family of datasets from one folder."""
        for n in names:
            self.register(f"{prefix}{n}", lambda spark, n=n: spark.read.parquet(f"{folder}/{n}.parquet"))


CATALOG = Catalog()


class Registry(dict):
    """Named factories (trackers, adapters, kernels); a name is given once."""

    def add(self, name: str):
        def put(f):
            if name in self:
                raise ValueError(f"{name} is registered")
            self[name] = f
            return f

        return put


def bundles(files: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Folders (of paths in files) that hold all required files, hidden ones left out, by name in any case."""
    from pyspark.sql import functions as F

    parts = F.split("path", "/")
    rows = files.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"), F.element_at(parts, -1).alias("name"))
    found = rows.where(F.col("name").isin(*required)).groupBy("folder").agg(F.count_distinct("name").alias("n"))
    name = F.element_at(F.split("folder", "/"), -1)
    return found.where((F.col("n") == len(required)) & ~name.startswith(".")).select("folder").orderBy(F.lower(name))
