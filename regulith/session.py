"""Session settings and the few places where a job touches cluster state."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on. They are session-level, so they can be applied
# to a session that somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings this library relies on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(name: str = "regulith", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", os.environ.get("REGULITH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FALLBACK: dict[str, str] = {}  # of local sessions without a setting, by application


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a temporary folder; the setting itself is never changed.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _FALLBACK:
        _FALLBACK[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _FALLBACK[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, if there."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def move_path(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder of the shared store its place, which must be free; nothing is copied."""
    system, source = _file_system(spark, path)
    _, place = _file_system(spark, to)
    system.mkdirs(place.getParent())
    if system.exists(place) or not system.rename(source, place):
        raise OSError(f"cannot move {path} to {to}")


def materialise(df: DataFrame, label: str, plain: bool = False) -> DataFrame:
    """Cut lineage by writing a table in the shared folder and reading it back.

    Used where several outputs are derived from one costly intermediate: the
    written table survives the loss of executors, a cache does not.

    The planner takes the size of the files for that of the rows. Narrow tables of repeated values shrink to a tenth or
    less in files and would be broadcast, through the driver, although their rows fill its memory; ``plain`` writes them
    neither compressed nor by dictionary, so that their files are as large as their values.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.mode("error")
    if plain:
        writer = writer.option("compression", "none").option("parquet.enable.dictionary", "false")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bind(value: Column, use) -> Column:
    """Evaluate a sub-expression once and use it several times inside one expression."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
