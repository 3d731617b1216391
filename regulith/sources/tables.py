"""Readers and writers. Schemas are explicit wherever the format does not carry one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regulith.functions.urls import storage_key
from regulith.operators.filters import SignalFilter, filter_signals

SEGMENTS = "array<struct<start_index:int,end_index:int>>"
CELL = f"struct<layout:struct<text_anchor:struct<text_segments:{SEGMENTS}>>>"
ROW = f"struct<cells:array<{CELL}>>"
BLOCK = f"struct<layout:struct<confidence:double,text_anchor:struct<text_segments:{SEGMENTS}>>>"
PAGE = f"struct<blocks:array<{BLOCK}>,tables:array<struct<header_rows:array<{ROW}>,body_rows:array<{ROW}>>>>"
LAYOUT_SCHEMA = f"doc_id bigint, url string, text string, pages array<{PAGE}>"


def load(spark: SparkSession, base: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{base}/{name}.parquet")


def read_layout_json(spark: SparkSession, path: str, multi_line: bool = True, schema: str = LAYOUT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_json(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "error") -> None:
    df.write.mode(mode).partitionBy(*partition_by).json(path)


def append(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def with_storage_key(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("storage_key", storage_key("domain", "fetched_at", "checksum", "original_url", "content_type"))


# Header of the export and the column behind each heading.
SIGNAL_EXPORT = [
    ("Signal ID", "signal_id"), ("Title", "title"), ("Title (EN)", "title_en"), ("Content", "content"), ("Content (EN)", "content_en"),
    ("Type", "signal_type"), ("Priority", "priority"), ("Province", "province"), ("Asset Type", "asset_type"), ("Source URL", "source_url"),
    ("Published Date", "published_date"), ("Effective Date", "effective_date"), ("Deadline Date", "deadline_date"), ("Tags", "tags"),
    ("Impact Score", "impact_score"), ("Relevance Score", "relevance_score"), ("Created At", "created_at"), ("Updated At", "updated_at"),
]


def signal_export_frame(signals: DataFrame, filters: SignalFilter) -> DataFrame:
    """The exported columns; columns the table lacks are empty."""
    rows = filter_signals(signals, filters)
    out = []
    for heading, name in SIGNAL_EXPORT:
        if name not in rows.columns:
            value = F.lit("")
        elif name == "tags":
            value = F.array_join("tags", ", ")
        else:
            value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        out.append(value.alias(heading))
    return rows.select(*out)


def export_signals_csv(signals: DataFrame, filters: SignalFilter, path: str, mode: str = "error") -> None:
    signal_export_frame(signals, filters).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)
