"""A training corpus from documents: stages that each work on all rows the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regulith.llm.decontaminate import drop_contaminated
from regulith.llm.line_templates import drop_recurring_lines, fresh
from regulith.llm.minhash import near_duplicates
from regulith.llm.packing import pack_documents
from regulith.llm.toxicity import reject_toxic
from regulith.session import materialise, scratch_path
from regulith.sources.tables import load


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not predict as toxic.

    Rows are judged by their text alone: null and empty texts and repeated rows are scored like others, extra columns stay,
    an empty table gives no rows.
    """
    return reject_toxic(docs, load(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs in other documents; a document that loses all lines stays, empty.

    Null texts stay null. Rows that repeat an id count as one document; a null id ranks after all others. n_chars follows
    the new text. An empty table gives no rows.
    """
    out = drop_recurring_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of smallest id, of equal ids that of smallest text hash, language and source.

    Classes are of rows, so rows that share an id are kept or dropped each by its own text, and of equal rows one stays. Null
    ids rank last; null and empty texts, linked with nothing, all stay. An empty table gives no rows.
    """
    row, head = fresh(docs, "_row", "_head")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")  # numbers that later readings share
    classes = near_duplicates(rows, width=5, percent=80, id_col=row).select(row, F.col("component_id").alias(head))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col("lang").isNull(), "lang", F.col("source").isNull(), "source", row)
    heads = rows.select(row, order.alias("_order")).join(classes, row).groupBy(head).agg(F.min("_order")[row].alias(row))
    return rows.join(heads.select(row), row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; repeated rows are judged each; null items are no items. An empty table gives no rows.
    """
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins of 2,048 words.

    Null and empty texts are one piece without a bin; repeated rows are packed each. An empty table gives no rows.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None  # a learned model, an estimate and a greedy packing have no SQL; tests hold the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; the last one's rows are returned unwritten."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
