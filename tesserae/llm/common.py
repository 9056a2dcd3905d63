"""Helpers that the corpus operators share: scratch tables, checked broadcasts, salted joins."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tesserae.session import BROADCAST_ROWS, at_most, dealt, fresh_dir, ready, small, work_dir, written

__all__ = ["BROADCAST_ROWS", "again", "at_most", "dealt", "drop_table", "fresh_dir", "id_key", "join_hot", "let", "ready", "small", "text_key", "text_of", "tidied", "whole", "work_dir", "written"]

#: Words of the quality and n-gram contracts: everything but ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"
#: Stands for a null doc_id where a key must compare equal to itself.
NO_ID = -(2**63)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that written() made, and let Spark remove the shuffle files of queries that are done, which it does
    when the driver collects its garbage."""
    spark = df.sparkSession
    spark._jvm.System.gc()
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text, in tables as large as can be."""
    return F.unhex(F.md5(text.cast("binary")))


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int = 16, salt_by: list[str] | None = None, small: bool | None = None) -> DataFrame:
    """Join where one key may hold a third of left's rows and right has one row a key.

    right is broadcast if its row count, which is measured unless `small` says it, allows that; else left is salted and right repeated
    for each salt, so a hot key is dealt over `salts` tasks.
    """
    if at_most(right) if small is None else small:
        return left.join(F.broadcast(right), keys, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_by or left.columns]), F.lit(salts)).cast("int")
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(dealt(many), [*keys, "_salt"], how).drop("_salt")


def whole(docs: DataFrame, *others: Column) -> DataFrame:
    """docs' rows as one column `row`, whatever its columns are called, beside others."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *others)


def again(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of whole() once more, in order, with some changed."""
    return df.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns])


def tidied(run: Callable, *drops: Callable[[], None]) -> Callable:
    """run, an iterator over Arrow batches, which at a task's end lets go of what its worker would keep: caches and freed memory."""

    def whole_task(batches: Iterator) -> Iterator:
        yield from run(batches)
        for drop in drops:
            drop()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only in glibc
            ctypes.CDLL(None).malloc_trim(0)

    return whole_task


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: a lambda's variable is never inlined again."""
    return F.element_at(F.transform(F.array(value), body), 1)

