"""Tables merged partition by partition: a batch reads and rewrites the partitions of its keys and no other.

A table is a folder of parquet files partitioned by ``part``, a hash of the column that owns the rows (a document, a
checksum). The new partitions are first written beside the table, then put in place by dynamic partition overwrite, so a
failed run leaves the table as it was and a repeated one gives the same rows. Only the numbers of touched partitions, at
most ``parts`` of them, reach the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regulith.operators.maintenance import delete_where, upsert
from regulith.operators.windows import latest_per_key
from regulith.session import col, drop_path, move_path, path_exists

PART = "part"


def part_of(owner: Column | str, parts: int) -> Column:
    """The partition of a row; null owners share one."""
    return F.pmod(F.xxhash64(col(owner)), F.lit(parts)).cast("int")


def _numbers(df: DataFrame) -> list[int]:
    return [row[0] for row in df.select(PART).distinct().collect()]


def _replace(spark: SparkSession, rows: DataFrame, target: str, touched: list[int]) -> None:
    """Put ``rows`` (with part) in the place of the touched partitions; one that has no rows left is removed."""
    staged = f"{target}-staged"
    rows.repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(staged)
    ready = spark.read.schema(rows.schema).parquet(staged)
    held = _numbers(ready)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(target)
    for number in set(touched) - set(held):
        drop_path(spark, f"{target}/{PART}={number}")
    drop_path(spark, staged)


def merge_into(target: str, updates: DataFrame, keys: list[str], cols: list[str], owner: str, as_of: dt.datetime, order: str | list[str],
               parts: int = 16, owners: DataFrame | None = None, batch: int = 0) -> None:
    """Insert or update rows by key (M1) in the table at ``target``: keys, cols, change, updated_at, batch.

    Rows of an owner lie in one partition, as ``owner`` is one of keys and cols. With ``owners``, a table of that column, the
    rows of these owners that ``updates`` no longer has are removed. ``change`` says what the last batch that touched the
    row's partition did to it; if that batch is repeated it stays as it was. Partitions that the table does not have yet are
    written once and moved into it, if no key is repeated.
    """
    spark = updates.sparkSession
    made = f"{target}-made"
    fresh = updates.select(*keys, *cols).withColumns({"change": F.lit("inserted"), "updated_at": F.lit(as_of), "batch": F.lit(batch).cast("bigint"), PART: part_of(owner, parts)})
    fresh.write.mode("overwrite").partitionBy(PART).parquet(made)  # updates are made once, and lie as the table will
    stored = spark.read.schema(fresh.schema).parquet(made)
    new = stored.select(*keys, *cols, PART)
    filled = _numbers(stored)
    touched = filled if owners is None else sorted({*filled, *_numbers(owners.select(part_of(owner, parts).alias(PART)))})
    if not touched:
        return
    repeated_keys = stored.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    if not any(path_exists(spark, f"{target}/{PART}={n}") for n in touched) and repeated_keys.isEmpty():
        for n in filled:  # nothing to merge with: no row is shuffled or written again
            move_path(spark, f"{made}/{PART}={n}", f"{target}/{PART}={n}")
        drop_path(spark, made)
        return
    if path_exists(spark, target):
        current = spark.read.parquet(target).filter(F.col(PART).isin(touched))
    else:
        current = new.limit(0).withColumns({"change": F.lit(""), "updated_at": F.lit(as_of), "batch": F.lit(0).cast("bigint")})
    if owners is not None:
        again = current.join(owners.select(owner).distinct(), owner, "left_semi").join(new.select(*keys), keys, "left_anti").select(*keys)
        current = current.join(again, keys, "left_anti")
    told = current.select(*keys, F.col("change").alias("_change"), F.col("batch").alias("_batch"))
    merged, _ = upsert(current.select(*keys, *cols, "updated_at"), new, keys, cols, as_of, order)
    merged = merged.join(told, keys, "left")
    repeated = (F.col("_batch") == batch) & (F.col("change") == "updated")
    merged = merged.withColumn("batch", F.when(F.col("change") == "kept", F.col("_batch")).otherwise(F.lit(batch).cast("bigint")))
    merged = merged.withColumn("change", F.when(repeated, F.col("_change")).otherwise(F.col("change")))
    _replace(spark, merged.select(*keys, *cols, "change", "updated_at", "batch", part_of(owner, parts).alias(PART)), target, touched)
    drop_path(spark, made)


def delete_from(target: str, owners: DataFrame, owner: str, spark: SparkSession, parts: int = 16, **criteria) -> None:
    """Delete (M5) rows of the given owners in the table at ``target``; ``criteria`` as of ``delete_where`` narrow what goes."""
    wanted = owners.select(owner).distinct()
    touched = _numbers(wanted.select(part_of(owner, parts).alias(PART)))
    if not touched or not path_exists(spark, target):
        return
    current = spark.read.parquet(target).filter(F.col(PART).isin(touched))
    if criteria:
        listed = current.join(wanted, owner, "left_semi")
        kept = current.join(wanted, owner, "left_anti").unionByName(delete_where(listed, **criteria))
    else:
        kept = current.join(wanted, owner, "left_anti")
    _replace(spark, kept, target, touched)


def append_unseen(target: str, rows: DataFrame, key: str, order: list[Column], run: str, batch: int, parts: int = 16) -> None:
    """Store (T3) the first row of each key that the table at ``target`` does not hold yet; a repeated batch changes nothing.

    Stored keys are looked up in the partitions of the batch's keys only. Rows of one run and batch have a folder of their
    own in each partition, which a repetition overwrites.
    """
    spark = rows.sparkSession
    new = rows.filter(F.col(key).isNotNull()).withColumn(PART, part_of(key, parts))
    touched = _numbers(new)
    if not touched:
        return
    first = latest_per_key(new, [key], order)
    if path_exists(spark, target):
        stored = spark.read.parquet(target).filter(F.col(PART).isin(touched) & ~((F.col("run") == run) & (F.col("batch") == batch)))
        known = stored.select(PART, key).join(first.select(PART, key), [PART, key], "left_semi")
        first = first.join(known, [PART, key], "left_anti")
    first = first.select(*rows.columns, PART).withColumns({"run": F.lit(run), "batch": F.lit(batch)})
    first.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART, "run", "batch").parquet(target)

