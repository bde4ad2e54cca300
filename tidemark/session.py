"""Session helpers: a local session for tests and the shared folder used to cut long lineages."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_OPEN: list[list[str]] = []


def local_session(cores: int | str = "*", app: str = "tidemark") -> SparkSession:
    """A session for tests and the bench; on a cluster the session comes from spark-submit."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not (spark.conf.get(_CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(_CHECKPOINT_CONF)):
        # One machine: its own folder is shared by all tasks.
        spark.conf.set(_CHECKPOINT_CONF, f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on: UTC wall clock, adaptive plans, reliable checkpoints."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # Quantile sketches of up to this many groups stay hashed before the aggregate sorts instead.
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "512")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it."""
    folder = spark.conf.get(_CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(_CHECKPOINT_CONF)
    if not folder:
        raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder that the driver and all executors share")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove on exit what operators staged inside.

    Results are lazy and read the staged tables, so write or collect them before leaving. Without this
    context staged tables stay until the shared folder's owner removes them.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Used between operators that read their input more than once, so a chain of them does not
    recompute its whole history. The table is columnar, so the next pass reads only the columns it
    needs, and a lost executor re-reads files instead of recomputing the chain.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
