"""Running a stream over what is available now, into tables of the shared folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regulith.operators import parted
from regulith.operators.windows import latest_per_key
from regulith.session import scratch_path


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, max_files: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream. What the pattern names may be a file or, as Spark writes tables, a folder of files.

    The braces make the path a glob: Spark takes a plain path for a base folder, which a single file is not.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{folder}/{{{pattern}}}")


def run_append(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Append-mode result through the transactional parquet sink. A ``path`` given again resumes where its checkpoint stands."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_update(stream: DataFrame, keys: list[str], label: str, path: str | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Update-mode result: each batch overwrites its own folder, so a repeated batch changes nothing.

    Of a key's rows the last batch's holds, of several in one batch that of largest ``within``. A ``path`` given again
    resumes where its checkpoint stands.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/part={batch_id}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return latest_per_key(rows, keys, [F.col("_batch").desc(), *(F.col(c).desc() for c in within)]).drop("_batch")


def ingest_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, keys: list[str], cols: list[str],
                  as_of: dt.datetime, order: str | list[str], owner: str, parts: int = 16) -> DataFrame:
    """Documents arriving as files -> the same transforms as in batch -> merge into the table at ``target``.

    A batch rewrites the partitions of its owners only (``parted.merge_into``). Of equal keys in a batch the row last by
    ``order`` wins. Rows of an owner that arrives again are replaced as a whole, so a document that became shorter
    leaves no chunks behind. The checkpoint lies beside the table: the same target resumes where it stands.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        parted.merge_into(target, transform(batch).select(*keys, *cols), keys, cols, owner, as_of, order, parts, batch.select(owner), batch_id)

    query = stream.writeStream.option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True).foreachBatch(merge).start()
    query.awaitTermination()
    return spark.read.parquet(target)


def dedup_stream(stream: DataFrame, target: str, key: str, order: list[str], run: str = "main", parts: int = 16) -> DataFrame:
    """Rows whose key the table at ``target`` does not hold yet, stored there; returns the table.

    What was seen is the table itself, not state of the stream: it may be as old as the table and other streams may have
    written it. Streams of several ``run`` names share a target; each resumes at its own checkpoint.
    """
    spark = stream.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        parted.append_unseen(target, batch, key, [F.col(c) for c in order], run, batch_id, parts)

    query = stream.writeStream.option("checkpointLocation", f"{target}-checkpoint-{run}").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    return spark.read.parquet(target)
