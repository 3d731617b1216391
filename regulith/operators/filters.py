"""Row filters and projections over citation, source, signal and candidate tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from regulith.functions.dates import cadence_hours
from regulith.functions.text import has_cjk, passage, strip
from regulith.functions.urls import domain_suffixes
from regulith.session import col
from regulith.sources import vocab


def scope(df: DataFrame, province: str, doc_class: str, asset: str | None = None) -> DataFrame:
    """Equality filter on the scope columns; prunes partitions on a table partitioned by province."""
    out = df.filter((F.col("province") == province) & (F.col("doc_class") == doc_class))
    return out.filter(F.col("asset") == asset) if asset is not None else out


def active(df: DataFrame) -> DataFrame:
    return df.filter(F.col("superseded_by").isNull())


def search_content(df: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Case-insensitive substring search, newest first when limited."""
    hits = active(df).filter(F.contains(F.lower(F.col("content")), F.lit(text.lower())))
    if limit is None:
        return hits
    return hits.orderBy(F.col("effective_date").desc(), F.col("citation_id")).limit(limit)


@dataclass(frozen=True)
class SignalFilter:
    """Optional facets; an empty facet does not filter."""

    provinces: list[str] = field(default_factory=list)
    asset_types: list[str] = field(default_factory=list)
    signal_types: list[str] = field(default_factory=list)
    priorities: list[str] = field(default_factory=list)
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    keywords: str | None = None
    min_impact_score: float | None = None


def keyword_match(df: DataFrame, keyword: str, cols=("title", "content"), array_col: str = "tags") -> DataFrame:
    needle = F.lit(keyword.lower())
    hit = F.exists(F.col(array_col), lambda t: F.contains(F.lower(t), needle))
    for name in cols:
        hit = hit | F.contains(F.lower(F.col(name)), needle)
    return df.filter(hit)


def filter_signals(df: DataFrame, f: SignalFilter) -> DataFrame:
    for name, values in (("province", f.provinces), ("asset_type", f.asset_types),
                         ("signal_type", f.signal_types), ("priority", f.priorities)):
        if values:
            df = df.filter(F.col(name).isin(values))
    if f.date_from:
        df = df.filter(F.col("published_date") >= F.lit(f.date_from))
    if f.date_to:
        df = df.filter(F.col("published_date") <= F.lit(f.date_to))
    if f.min_impact_score is not None:
        df = df.filter(F.col("impact_score") >= f.min_impact_score)
    return keyword_match(df, f.keywords) if f.keywords else df


def recent(df: DataFrame, ts: str, hours: float, as_of: dt.datetime) -> DataFrame:
    return df.filter(F.col(ts) >= F.lit(as_of - dt.timedelta(hours=hours)))


def stale_sources(df: DataFrame, as_of: dt.datetime, hours: float = 48) -> DataFrame:
    last = F.col("last_crawled_at")
    return df.filter(F.col("enabled") & (last.isNull() | (last < F.lit(as_of - dt.timedelta(hours=hours)))))


def stale_by_cadence(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Each row's own interval decides."""
    last = F.col("last_crawled_at")
    limit = F.unix_timestamp(F.lit(as_of)) - cadence_hours("cadence") * 3600
    return df.filter(F.col("enabled") & (last.isNull() | (F.unix_timestamp(last) < limit)))


def allow_domains(df: DataFrame, allow: DataFrame, domain_col: str = "domain", anti: bool = False) -> DataFrame:
    """Keep (or with ``anti`` drop) rows whose host the allowlist covers.

    The suffix rule becomes an equality join: every dot-suffix of the distinct hosts is looked up in
    the allowlist, then the matched hosts filter the table. No pair of host and entry is enumerated.
    """
    hosts = df.select(F.col(domain_col).alias("_host")).filter("_host is not null").distinct()
    entries = allow.select(F.lower(F.col("domain")).alias("_entry")).distinct()
    covered = (
        hosts.select("_host", F.explode(domain_suffixes("_host")).alias("_entry"))
        .join(entries, "_entry", "left_semi").select("_host").distinct()
    )
    return df.join(covered, df[domain_col] == covered["_host"], "left_anti" if anti else "left_semi")


def official(domain: Column | str, mode: str = "contains") -> Column:
    domain = col(domain)
    if mode == "regex":
        return F.coalesce(domain.rlike(vocab.OFFICIAL_PATTERN), F.lit(False))
    entries = F.array(*[F.lit(p) for p in vocab.OFFICIAL_DOMAINS])
    return F.coalesce(F.exists(entries, lambda p: F.contains(domain, p)), F.lit(False))


def official_flag(df: DataFrame, mode: str = "contains") -> DataFrame:
    return df.withColumn("is_official", official("domain", mode))


def candidate_flags(df: DataFrame, allow: DataFrame, min_conf: float = 0.3) -> DataFrame:
    """Label candidates instead of dropping them: one pass gives both rows and counts."""
    listed = allow_domains(df.select("domain").distinct(), allow).withColumn("_listed", F.lit(True))
    joined = df.join(listed, "domain", "left")
    keep = F.coalesce(F.col("_listed"), F.lit(False)) & F.col("url").rlike("^https?://") & (F.col("confidence_score") >= min_conf)
    return joined.withColumn("kept", keep).drop("_listed")


def validate_candidates(df: DataFrame, allow: DataFrame, min_conf: float = 0.3) -> tuple[DataFrame, DataFrame]:
    flagged = candidate_flags(df, allow, min_conf)
    counts = flagged.agg(
        F.count_if(F.col("kept")).alias("kept_count"), F.count_if(~F.col("kept")).alias("filtered_count")
    )
    return flagged.filter("kept").drop("kept"), counts


def store_candidates(df: DataFrame, allow: DataFrame, path: str, min_conf: float = 0.3) -> dict[str, int]:
    """Write the valid candidates and count the dropped ones on the same pass: kept_count and filtered_count."""
    seen = Observation("candidates")
    kept, dropped = F.count_if("kept").alias("kept_count"), F.count_if(~F.col("kept")).alias("filtered_count")
    candidate_flags(df, allow, min_conf).observe(seen, kept, dropped).filter("kept").drop("kept").write.mode("overwrite").parquet(path)
    return seen.get


def allowed_content_type(df: DataFrame, types: list[str] = vocab.CONTENT_TYPES) -> DataFrame:
    base = F.trim(F.substring_index(F.lower(F.col("content_type")), ";", 1))
    return df.filter(F.exists(F.array(*[F.lit(t) for t in types]), lambda t: F.contains(base, t)))


def within_size(df: DataFrame, max_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    return df.filter(F.col("content_length") <= max_bytes)


def high_confidence(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    return df.filter(
        (F.col("verification_status") == "verified") & (F.col("http_status") == 200)
        & (F.col("combined_confidence") >= threshold)
    )


def has_chinese(df: DataFrame, text_col: str = "content", min_ratio: float | None = 0.3) -> DataFrame:
    return df.filter(has_cjk(text_col, min_ratio))


def enrich_results(df: DataFrame) -> DataFrame:
    """Search hits with the passage cut out, unless they have it, and the descriptive columns nested."""
    meta = F.struct("title", "url", F.date_format("effective_date", "yyyy-MM-dd").alias("effective_date"),
                    "checksum", "province", "doc_class", "asset")
    return df.select("question_id", "citation_id", F.col("passage") if "passage" in df.columns else passage("content").alias("passage"), "score",
                     F.col("vscore").alias("vector_score"), F.col("tscore").alias("text_score"), "rank", meta.alias("metadata"))


def fill_metadata(df: DataFrame) -> DataFrame:
    meta = F.col("metadata")
    for name, default in (("effective_date", "未知"), ("title", "未知文档"), ("url", "")):
        meta = meta.withField(name, F.coalesce(F.col(f"metadata.{name}"), F.lit(default)))
    return df.withColumn("metadata", meta).withColumn("validation_passed", F.lit(True))


def complete_citations(df: DataFrame) -> DataFrame:
    """Rows with a non-empty id, title, date and passage."""
    filled = lambda c: F.coalesce(F.length(strip(F.col(c).cast("string"))) > 0, F.lit(False))
    return df.filter(filled("citation_id") & filled("metadata.title") & filled("metadata.effective_date") & filled("passage"))
