"""Validation labels rows with error codes; nothing raises per row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulith.functions.checks import errors, is_cadence, is_domain, is_sha256, is_url
from regulith.functions.dates import cadence_hours
from regulith.functions.text import cjk_ratio, sha256_hex, strip
from regulith.operators.aggregates import coverage_gap, duplicate_report
from regulith.operators.filters import official
from regulith.operators.joins import map_value
from regulith.sources import vocab


def _known(c: str, aliases: dict[str, str]) -> Column:
    return map_value(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))), aliases).isNotNull()


def _empty(c: Column) -> Column:
    return c.isNull() | (F.length(strip(c)) == 0)


def validate_citations(df: DataFrame, as_of: dt.date) -> DataFrame:
    listed = F.exists(F.array(*[F.lit(d) for d in vocab.URL_ALLOWLIST]), lambda d: F.contains(F.lower(F.col("url")), d))
    date = F.col("effective_date")
    return df.withColumn("errors", errors(
        title=_empty(F.col("title")) | (F.length(strip("title")) > 500),
        url=~is_url("url"), url_domain=~listed, checksum=~is_sha256("checksum"),
        date_missing=date.isNull(), date_future=date > F.lit(as_of), date_old=date < F.lit(as_of - dt.timedelta(days=3650)),
        province=~_known("province", vocab.PROVINCE_ALIASES), doc_class=~_known("doc_class", vocab.DOC_CLASS_ALIASES),
        asset=F.col("asset").isNotNull() & ~_known("asset", vocab.ASSET_ALIASES),
    ))


def validate_queries(df: DataFrame, max_len: int = 500) -> DataFrame:
    question = F.length(strip("question"))
    return df.withColumn("errors", errors(
        province=~_known("province", vocab.PROVINCE_ALIASES), doc_class=~_known("doc_class", vocab.DOC_CLASS_ALIASES),
        asset=~_known("asset", vocab.ASSET_ALIASES), question_short=F.coalesce(question, F.lit(0)) < 3, question_long=question > max_len,
        limit=(F.col("k") < 1) | (F.col("k") > 20),
    ))


def validate_embeddings(df: DataFrame, dim: int) -> DataFrame:
    v = F.col("embedding")
    return df.withColumn("errors", errors(
        missing=v.isNull() | (F.size(v) == 0), dimension=F.size(v) != dim,
        not_finite=F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), out_of_range=F.exists(v, lambda x: F.abs(x) > 10),
    ))


def validate_chinese(df: DataFrame, text_col: str = "content", min_ratio: float = 0.3) -> DataFrame:
    ratio = cjk_ratio(strip(text_col))
    return df.withColumn("errors", errors(
        missing=_empty(F.col(text_col)), no_alphanumeric=~_empty(F.col(text_col)) & ratio.isNull(), low_ratio=ratio < min_ratio))


def validate_registry(sources: DataFrame) -> DataFrame:
    """Long form (severity, subject, message): per source, across sources and per province."""
    hours = cadence_hours("cadence")
    issue = lambda bad, severity, text: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("message")))
    rules = F.array(
        issue(~is_domain("domain"), "error", "invalid domain"),
        issue(~official("domain", "regex"), "warning", "not an official domain"),
        issue(F.size("doc_classes") == 0, "error", "no document class"),
        issue((F.col("priority") == "high") & ~F.col("enabled"), "warning", "high priority source is disabled"),
        issue(~is_cadence("cadence"), "error", "invalid cadence"),
        issue(hours > 168, "warning", "infrequent crawling"),
    )
    own = sources.select(F.col("domain").alias("subject"), F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("r.severity", "subject", "r.message")
    twice = duplicate_report(sources).select(F.lit("error").alias("severity"), F.col("domain").alias("subject"), F.lit("duplicate domain").alias("message"))
    gaps = coverage_gap(sources)
    missing = gaps.filter("not coverage_complete").select(
        F.lit("warning").alias("severity"), F.col("province").alias("subject"),
        F.concat(F.lit("missing "), F.array_join("missing_doc_classes", ",")).alias("message"))
    unranked = gaps.filter("high_priority_sources = 0").select(
        F.lit("warning").alias("severity"), F.col("province").alias("subject"), F.lit("no high priority source").alias("message"))
    return own.unionByName(twice).unionByName(missing).unionByName(unranked)


def validate_snapshots(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", errors(
        empty=F.coalesce(F.length("content"), F.lit(0)) == 0, checksum_format=~is_sha256("checksum"),
        checksum=F.col("checksum") != sha256_hex("content"), length=F.col("content_length") != F.length("content")))


def constraint_report(df: DataFrame, **rules: Column) -> DataFrame:
    """Violations per constraint in one pass; NULL satisfies a constraint, as in SQL."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in rules.items()], F.count("*").alias("_rows"))
    rows = F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(n).alias("violations"), F.col("_rows").alias("rows")) for n in rules])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def citation_constraints() -> dict[str, Column]:
    return {"doc_class": F.col("doc_class").isin(vocab.DOC_CLASSES), "asset": F.col("asset").isin(vocab.ASSETS)}


def log_constraints() -> dict[str, Column]:
    return {"verdict": F.col("verdict").isin(vocab.VERDICTS), "latency": F.col("latency_ms") >= 0}


def job_constraints() -> dict[str, Column]:
    return {"job_status": F.col("job_status").isin(vocab.JOB_STATUSES), "job_type": F.col("job_type").isin(vocab.JOB_TYPES)}


def metric_constraints() -> dict[str, Column]:
    return {c: F.col(c).between(0, 1) for c in ("groundedness_score", "citation_precision", "refusal_accuracy")}
