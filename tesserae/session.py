"""Session settings the engine is tested with, and the shared folder for tables between stages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a side of a join is broadcast, after they have been counted; they are narrow, so this is 20 MB or so.
BROADCAST_ROWS = 100_000
_OWN: dict[str, str] = {}


def local_session(cores: int = 8, memory: str = "8g", name: str = "tesserae") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller's own session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder only in local mode without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tesserae-"))


def _own_dir(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/tesserae-{spark.sparkContext.applicationId}"


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}/{tag}"


def clean(spark: SparkSession) -> None:
    """Remove all tables between stages that this application wrote. DataFrames that read them are of no use after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back; cuts the lineage so that a lost executor costs no recomputation."""
    path = fresh_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has no more rows than this; reads rows + 1 at most."""
    return df.limit(rows + 1).count() <= rows


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that must not travel whole. Spark sizes a table by its compressed files, before rows are exploded, and would
    broadcast millions of rows through the driver."""
    return df.hint("merge")


def small(df: DataFrame) -> DataFrame:
    """A side of a join, broadcast if its rows, which are counted, allow that; else dealt."""
    return F.broadcast(df) if at_most(df) else dealt(df)


#: Rows of an Arrow batch at most: texts and masks are long, and a batch is held several times between Spark and Python.
BATCH_ROWS = 1_000
#: Bytes after which an Arrow batch ends before that.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it isn't installed (a cluster gets it by --py-files), and keep batches small."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(size)) <= BATCH_ROWS:
        spark.conf.set(size, str(BATCH_ROWS))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark
