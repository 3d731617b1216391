"""From layout documents to citations: one chain of narrow steps up to the final upsert."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulith.functions.layout import table_count
from regulith.functions.text import sha256_hex, stable_id
from regulith.operators.maintenance import upsert
from regulith.operators.windows import latest_per_key
from regulith.plans.chunking import chunk_document, embed_prepare, with_paragraphs
from regulith.plans.effective_dates import effective_date
from regulith.plans.ontology import Thresholds, Vocabulary, ontology_map
from regulith.session import materialise


@dataclass(frozen=True)
class IngestTables:
    citations: DataFrame
    changes: DataFrame
    chunks: DataFrame
    embedding_input: DataFrame
    jobs: DataFrame


# What a job that stored no chunk reports.
NO_CONTENT, NO_CHUNKS = "Content normalization failed", "Text chunking failed"


def job_results(meta: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per document in the form of ``aggregates.ocr_metrics``: status, error, pages, tables, date found, chunks.

    A job fails if its text has no paragraph, or none that gives a chunk. A batch has no processing time per document, so
    that is null.
    """
    made = chunks.groupBy("doc_id").agg(F.count("*").alias("_made"))
    rows = meta.select("doc_id", "citation_id", "pages_processed", "tables_extracted", F.col("effective_date").isNotNull().alias("effective_date_found"), F.size("paragraphs").alias("_paras")).join(made, "doc_id", "left")
    error = F.when(F.col("_paras") == 0, NO_CONTENT).when(F.col("_made").isNull(), NO_CHUNKS)
    return rows.select(
        F.col("doc_id").alias("job_id"), "citation_id", F.when(error.isNull(), "success").otherwise("failed").alias("status"), error.alias("error"), "pages_processed", "tables_extracted",
        "effective_date_found", F.coalesce("_made", F.lit(0)).alias("chunks"), F.lit(None).cast("int").alias("processing_time_ms"))


CITATION_COLUMNS = ["province", "doc_class", "asset", "title", "url", "effective_date", "checksum", "content"]


def ingest_batch(layout_docs: DataFrame, citations: DataFrame, as_of: dt.datetime, kb: Vocabulary = Vocabulary(),
                 thresholds: Thresholds = Thresholds(), max_tokens: int = 800, overlap: int = 100, min_clause: int = 50) -> IngestTables:
    """``layout_docs``: doc_id, url, title, province, doc_class, text, pages. ``jobs`` has a row per stored document.

    A citation stores the whole text of its document, also of one without a chunk; ``min_clause`` and the least length of
    a paragraph only filter what is chunked, mapped and embedded.
    """
    docs = effective_date(with_paragraphs(layout_docs), as_of.date())
    keyed = docs.withColumn("checksum", sha256_hex("text")).withColumn("citation_id", stable_id("url", "checksum"))
    has_pages = "pages" in layout_docs.columns
    keyed = keyed.withColumns({  # counted before documents are dealt by id: the layout does not travel
        "pages_processed": F.size(F.coalesce("pages", F.array())) if has_pages else F.lit(1),
        "tables_extracted": table_count(F.col("pages")) if has_pages else F.lit(0)}).drop("pages")
    keyed = latest_per_key(keyed, ["citation_id"], [F.col("doc_id")])  # equal documents are one citation, told by the first
    # Citations, chunks, jobs and embedding input all start from these two tables. The asset is mapped where the text lies.
    meta = materialise(keyed.select(
        "doc_id", "citation_id", "province", "doc_class", "title", "url", "effective_date", "checksum", F.col("text").alias("content"), "paragraphs", "pages_processed", "tables_extracted"), "documents")
    chunks = chunk_document(meta.select("doc_id", "paragraphs"), max_tokens, overlap, min_clause)
    chunks = materialise(chunks.join(meta.select("doc_id", "citation_id", "province", "doc_class"), "doc_id"), "chunks")
    best = ontology_map(meta.select("citation_id", "province", "content"), kb, replace(thresholds, max_mappings=1), known="province")
    rows = meta.select("citation_id", *[c for c in CITATION_COLUMNS if c != "asset"]).join(best.select("citation_id", F.col("asset_type").alias("asset")), "citation_id", "left")
    merged, counts = upsert(citations, rows, ["citation_id"], CITATION_COLUMNS, as_of, order="checksum")
    return IngestTables(merged, counts, chunks, embed_prepare(chunks), job_results(meta, chunks))
