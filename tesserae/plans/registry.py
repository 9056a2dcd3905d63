"""The register that the query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def off_ties(sql: str) -> str:
    """round(x, k) as round(x + 10^-(k + 3), k), as r() rounds: quotients of whole cents often lie in the middle between two results, where
    the last places of a sum, and so its order, would decide."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end, comma = 1, start + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and depth == 1 else comma
            end += 1
        inner, places = sql[start + 6 : comma], int(sql[comma + 1 : end - 1])
        out += sql[at:start] + f"round(({off_ties(inner)}) + 1e-{places + 3}, {places})"
        at = end
    return out + sql[at:]


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) by its name, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = off_ties(sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, places: int = 4) -> Column:
    """Rounded double, off ties."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") + 10.0 ** -(places + 3), places)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")
