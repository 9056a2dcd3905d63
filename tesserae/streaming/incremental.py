"""Resumable work, idempotent additive upserts and fingerprints, on Structured Streaming and plain tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tesserae.operators import quantify


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def is_folder(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory()


def upsert_stream(source: DataFrame, folder: str, checkpoint: str, keys: list[str], value: str, threshold: float) -> StreamingQuery:
    """Start an additive upsert of measurement partials: each micro-batch is aggregated and written to its own folder, by number, so a
    batch that runs again after a failure overwrites itself and is never counted twice."""

    def batch(df: DataFrame, number: int) -> None:
        quantify.partials(df, keys, value, threshold).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The table that the batches so far add up to."""
    return quantify.merge(spark.read.parquet(folder).drop("batch"), keys)


def compact(spark: SparkSession, folder: str, keys: list[str], to: str) -> None:
    """Write the merged table as one batch elsewhere, for a folder of many small batches."""
    merged(spark, folder, keys).write.mode("overwrite").parquet(f"{to}/batch=-1")


class WorkLog:
    """Units of work and their states. States are appended, never changed; a unit's last row counts.

    Every append is a folder of its own that counts once its marker file is there. A run's results and the states that complete its
    units share one marker, so both show or neither does: what a run that broke off wrote is never read, and its units are done
    again, once. One run at a time claims units: it holds the log's lock, a file that only one can create.

    Units that were running when the log is opened are pending again; failed ones stay so unless they are to be retried."""

    STATES = ("pending", "running", "completed", "failed")
    SCHEMA = "unit string, state string, attempt int, error string, at timestamp, seq long"

    def __init__(self, spark: SparkSession, path: str, context: dict):
        self.spark, self.path = spark, path
        mark = fingerprint(context)
        if exists(spark, f"{path}/context"):
            had = spark.read.text(f"{path}/context").first()[0]
            if had != mark:
                raise ValueError("the log belongs to work with other settings")
        else:
            spark.createDataFrame([(mark,)], "value string").coalesce(1).write.text(f"{path}/context")

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _create(self, name: str) -> None:
        """A file that is there once only: an error if it is there already."""
        path, system = self._file(name)
        system.create(path, False).close()

    def _whole(self, kind: str) -> list[str]:
        """Folders of a kind whose marker is there."""
        marks, system = self._file("marks/*")
        names = [x.getPath().getName() for x in system.globStatus(marks) or []]
        return [f"{self.path}/{kind}/{x}" for x in sorted(names) if exists(self.spark, f"{self.path}/{kind}/{x}")]

    def rows(self) -> DataFrame:
        found = self._whole("rows")
        if not found:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*found)

    def results(self) -> DataFrame | None:
        """What completed runs gave; None before the first."""
        found = self._whole("results")
        return self.spark.read.parquet(*found) if found else None

    def states(self) -> DataFrame:
        return self.rows().groupBy("unit").agg(F.max_by(F.struct("state", "attempt", "error"), "seq").alias("s")).select("unit", "s.*")

    def _write(self, units: DataFrame, state: str, error: str | None, name: str) -> None:
        if state not in self.STATES:
            raise ValueError(f"no state {state}")
        last = self.rows().groupBy("unit").agg(F.max("seq").alias("_seq"), F.max("attempt").alias("_attempt"))
        rows = units.select(F.col("unit").cast("string")).distinct().join(last, "unit", "left")
        attempt = F.coalesce("_attempt", F.lit(0)) + (1 if state == "running" else 0)
        rows.select("unit", F.lit(state).alias("state"), attempt.cast("int").alias("attempt"), F.lit(error).cast("string").alias("error"), F.current_timestamp().alias("at"), (F.coalesce("_seq", F.lit(-1)) + 1).cast("long").alias("seq")).write.parquet(f"{self.path}/rows/{name}")

    def append(self, units: DataFrame, state: str, error: str | None = None) -> None:
        """units: unit. A new attempt begins with `running`."""
        name = uuid.uuid4().hex
        self._write(units, state, error, name)
        self._create(f"marks/{name}")

    def todo(self, units: DataFrame, retry_failed: bool = False) -> DataFrame:
        """units that aren't done: unknown, pending or interrupted ones, and failed ones if asked for."""
        done = ["completed"] if retry_failed else ["completed", "failed"]
        return units.join(self.states().where(F.col("state").isin(done)).select("unit"), "unit", "left_anti")

    def unlock(self) -> None:
        """Take away the lock of a run that is known to be dead."""
        path, system = self._file("lock")
        system.delete(path, False)

    def run(self, units: DataFrame, work: Callable[[DataFrame], DataFrame], retry_failed: bool = False) -> DataFrame | None:
        """Do what is left: work(units) gives a result, which is written, then shown together with its units' completion. Returns all
        results so far. An error while another run holds the lock."""
        try:
            self._create("lock")
        except Py4JJavaError as e:
            raise RuntimeError("another run holds this log; unlock() it if that run is dead") from e
        try:
            claimed = self.todo(units, retry_failed)
            if claimed.limit(1).count():
                name = uuid.uuid4().hex
                claimed.write.parquet(f"{self.path}/claims/{name}")  # the states change meanwhile
                left = self.spark.read.schema(claimed.schema).parquet(f"{self.path}/claims/{name}")
                self.append(left.select("unit"), "running")
                work(left).write.parquet(f"{self.path}/results/{name}")
                self._write(left.select("unit"), "completed", None, name)
                self._create(f"marks/{name}")
        finally:
            self.unlock()
        return self.results()

    def phases(self, units: DataFrame, work: Callable[[DataFrame], DataFrame], retries: int = 1) -> DataFrame | None:
        """run(), then as many passes over what failed or was left as asked for; stops early when nothing is."""
        out = self.run(units, work)
        for _ in range(retries):
            if self.todo(units, True).limit(1).count() == 0:
                break
            out = self.run(units, work, retry_failed=True)
        return out

    def run_in_batches(self, units: DataFrame, work: Callable[[DataFrame], DataFrame], size: int, progress: Callable[[str, int, int], None] | None = None, cancelled: Callable[[], bool] | None = None) -> DataFrame | None:
        """run() over `size` units or so at a time, told apart by hash. progress gets the phase, units done and units in all after each;
        cancelled is asked before each, and what was done until then stays done."""
        left = self.todo(units)
        total, rest = units.count(), left.count()
        for k in range(batches := -(-rest // size)):
            if cancelled and cancelled():
                break
            self.run(units.where(F.pmod(F.xxhash64(F.col("unit").cast("string")), F.lit(batches)) == k), work)
            if progress:
                progress("running", self.states().where("state = 'completed'").count(), total)
        else:
            if progress:
                progress("completed", self.states().where("state = 'completed'").count(), total)
        return self.results()

    def progress(self) -> DataFrame:
        return quantify.status_counts(self.states(), "state", list(self.STATES))


def fingerprint(context: dict, ignore: tuple[str, ...] = ("threshold_algorithm",)) -> str:
    """SHA-256 of the canonical JSON, without keys to ignore at any depth."""

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in ignore}
        return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x

    return hashlib.sha256(json.dumps(clean(context), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, size, modified) not indexed before; an error if one that was has changed."""
    both = found.join(known.select("path", F.col("size").alias("_s"), F.col("modified").alias("_m")), "path", "left")
    changed = F.col("_s").isNotNull() & ((F.col("_s") != F.col("size")) | (F.col("_m") != F.col("modified")))
    checked = both.withColumn("_ok", F.when(changed, F.raise_error(F.concat(F.lit("changed since it was indexed: "), F.col("path"))).cast("boolean")).otherwise(F.lit(True)))
    return checked.where(F.col("_ok") & F.col("_s").isNull()).drop("_s", "_m", "_ok")
