"""Statistics: one pass per table, distributions by grouping sets, exact percentiles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulith.functions.scoring import combined_confidence
from regulith.functions.urls import doc_format
from regulith.operators.filters import recent, stale_sources
from regulith.operators.scans import quantiles
from regulith.operators.windows import share_of_total, topk_per_key
from regulith.sources import vocab


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def distributions(df: DataFrame, facets: list[str], fill: str | None = None) -> DataFrame:
    """Counts per value of several columns in one aggregation: (facet, value, count).

    Every row becomes one small (facet, value) pair per facet; the partial aggregate folds them
    before the shuffle, so the exchange carries distinct values only.
    """
    pairs = F.array(*[
        F.struct(F.lit(name).alias("facet"),
                 (F.coalesce(F.col(name).cast("string"), F.lit(fill)) if fill is not None else F.col(name).cast("string")).alias("value"))
        for name in facets
    ])
    rows = df.select(F.explode(pairs).alias("p")).select("p.facet", "p.value").filter("value is not null")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("count"))


def coverage(citations: DataFrame) -> DataFrame:
    return citations.filter("embedding is not null").groupBy("province", "doc_class").agg(
        F.count("*").alias("citation_count"), F.min("effective_date").alias("earliest_date"), F.max("effective_date").alias("latest_date")
    )


def coverage_cube(citations: DataFrame) -> DataFrame:
    """The same counts in total, per province, per document class and per pair."""
    return citations.filter("embedding is not null").cube("province", "doc_class").agg(
        F.grouping_id().alias("grain"), F.count("*").alias("citation_count"),
        F.min("effective_date").alias("earliest_date"), F.max("effective_date").alias("latest_date"),
    )


def embedding_stats(embeddings: DataFrame, by: str) -> DataFrame:
    counts = embeddings.groupBy(by).agg(F.count("*").alias("count"), F.countDistinct("citation_id").alias("citations"))
    return share_of_total(counts, "count").orderBy(F.col("count").desc(), by)


def query_stats(logs: DataFrame, as_of: dt.datetime, hours: float = 24, province: str | None = None) -> DataFrame:
    rows = recent(logs, "created_at", hours, as_of)
    rows = rows.filter(F.col("province") == province) if province else rows
    total = F.count("*")
    return rows.agg(
        total.alias("total_queries"),
        *[F.count_if(F.col("verdict") == v).alias(f"{v}_queries") for v in vocab.VERDICTS],
        rate(F.count_if(F.col("verdict") == "refused"), total).alias("refusal_rate"),
        rate(F.count_if(F.col("verdict") == "error"), total).alias("error_rate"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
    )


def query_distribution(logs: DataFrame) -> DataFrame:
    return distributions(logs, ["province", "doc_class", "asset"], fill="none")


def signal_stats(signals: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Distributions plus total, recent and deadline counts as further facets."""
    facets = distributions(signals, ["signal_type", "priority", "province", "asset_type"])
    recent_rows = F.count_if(F.col("published_date") >= F.lit(as_of - dt.timedelta(days=days)))
    due = F.count_if(F.col("deadline_date") <= F.lit(as_of + dt.timedelta(days=days)))
    totals = signals.agg(F.count("*").alias("total"), recent_rows.alias("recent"), due.alias("due"))
    long = totals.select(F.explode(F.array(*[
        F.struct(F.lit("summary").alias("facet"), F.lit(n).alias("value"), F.col(n).alias("count")) for n in ("total", "recent", "due")
    ])).alias("r")).select("r.*")
    return facets.unionByName(long)


def request_stats(requests: DataFrame) -> DataFrame:
    return distributions(requests, ["status", "priority", "refusal_code"])


def refusal_stats(refusals: DataFrame) -> DataFrame:
    return distributions(refusals, ["code", "province", "doc_class", "asset"])


def refusal_rate(refusals: DataFrame, logs: DataFrame) -> DataFrame:
    n = logs.agg(F.count("*").alias("n")).scalar()
    return refusals.agg(F.count("*").alias("total_refusals")).withColumn("refusal_rate", rate(F.col("total_refusals"), n))


def job_stats(jobs: DataFrame, as_of: dt.datetime, hours: float = 24) -> DataFrame:
    facets = distributions(jobs, ["job_type", "job_status"])
    since = F.lit(as_of - dt.timedelta(hours=hours))
    totals = jobs.agg(
        F.count("*").alias("total"), F.count_if(F.col("job_status") == "pending").alias("pending"),
        F.count_if(F.col("job_status") == "processing").alias("running"),
        F.count_if(F.col("scheduled_at") >= since).alias("recent"),
    )
    long = totals.select(F.explode(F.array(*[
        F.struct(F.lit("summary").alias("facet"), F.lit(n).alias("value"), F.col(n).alias("count")) for n in totals.columns
    ])).alias("r")).select("r.*")
    return facets.unionByName(long)


def pack_summary(rows: DataFrame) -> DataFrame:
    """Per pack: distinct counts, date range, confidence and at most ten sources in order.

    One pass to the distinct sources of a pack, which carry the rest; scopes have small fixed domains, so their sets stay small.
    """
    scopes = ("province", "asset", "doc_class")
    per_source = rows.groupBy("pack_id", "source_url").agg(
        F.count("*").alias("n"), F.count("confidence_score").alias("scored"), F.sum("confidence_score").alias("sum"), F.min("confidence_score").alias("low"),
        F.max("confidence_score").alias("high"), F.min("effective_date").alias("first"), F.max("effective_date").alias("last"), *[F.collect_set(c).alias(c) for c in scopes])
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c))))
    stats = per_source.groupBy("pack_id").agg(
        F.sum("n").alias("total_citations"), distinct("province").alias("unique_provinces"), distinct("asset").alias("unique_assets"),
        distinct("doc_class").alias("unique_doc_classes"), F.count("source_url").alias("unique_sources"), F.min("first").alias("earliest"), F.max("last").alias("latest"),
        (F.sum("sum") / F.sum("scored")).alias("avg_confidence"), F.min("low").alias("min_confidence"), F.max("high").alias("max_confidence"))
    listed = topk_per_key(per_source.select("pack_id", "source_url").filter("source_url is not null"), ["pack_id"], [F.col("source_url")], 10)
    sources = listed.groupBy("pack_id").agg(F.array_join(F.sort_array(F.collect_list("source_url")), ",").alias("sources"))
    return stats.join(sources, "pack_id", "left")


def chunk_quality(chunks: DataFrame, min_tokens: int = 50, max_tokens: int = 800) -> DataFrame:
    t = F.col("token_count")
    return chunks.agg(
        F.count("*").alias("total_chunks"), F.avg(t).alias("avg_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"),
        F.count_if(t < min_tokens).alias("chunks_under_min"), F.count_if(t > max_tokens).alias("chunks_over_max"),
        F.sum(F.length("content")).alias("total_content_length"),
    )


def ocr_metrics(jobs: DataFrame, by: list[str] = ()) -> DataFrame:
    n, ok = F.count("*"), F.count_if(F.col("status") == "success")
    return jobs.groupBy(*by).agg(
        n.alias("total_jobs"), ok.alias("successful_jobs"), F.count_if(F.col("status") == "failed").alias("failed_jobs"),
        F.count_if(F.col("status") == "partial").alias("partial_jobs"), F.sum("pages_processed").alias("total_pages"),
        F.sum("tables_extracted").alias("total_tables"), rate(ok, n).alias("success_rate"),
        rate(F.count_if("effective_date_found"), n).alias("date_hit_rate"),
        F.avg(F.when(F.col("status") == "success", F.col("processing_time_ms"))).alias("avg_processing_time_ms"),
        rate(F.sum("pages_processed"), n).alias("pages_per_job"), rate(F.sum("tables_extracted"), n).alias("tables_per_job"),
    )


def latency_percentiles(df: DataFrame, value: str, by: list[str] = (), probs=(0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation over the non-zero values; groups may hold any share of them (``scans.quantiles``)."""
    found = quantiles(df.filter(F.col(value) != 0), value, list(by), tuple(probs))
    return found.select(*by, "n", *[F.col(f"q{i}").alias(f"p{round(x * 100)}") for i, x in enumerate(probs)])


# Service level targets.
SLO_TARGETS = {"success_rate": 0.95, "date_hit_rate": 0.80, "p95_processing_time_ms": 12000.0}


def slo_report(jobs: DataFrame, targets: dict[str, float] = SLO_TARGETS, by: list[str] = ()) -> DataFrame:
    keys = list(by)
    base = ocr_metrics(jobs, keys).select(*keys, "success_rate", "date_hit_rate", "avg_processing_time_ms")
    p95 = latency_percentiles(jobs, "processing_time_ms", keys, (0.95,)).select(*keys, F.col("p95").alias("p95_processing_time_ms"))
    joined = base.join(p95, keys, "left") if keys else base.withColumn("p95_processing_time_ms", p95.scalar())
    met = {
        "success_rate_met": F.col("success_rate") >= targets["success_rate"],
        "date_hit_rate_met": F.col("date_hit_rate") >= targets["date_hit_rate"],
        "p95_met": F.coalesce(F.col("p95_processing_time_ms"), F.lit(0.0)) <= targets["p95_processing_time_ms"],
    }
    out = joined.withColumns(met)
    return out.withColumn("overall_met", F.col("success_rate_met") & F.col("date_hit_rate_met") & F.col("p95_met"))


def success_average(df: DataFrame, value: str, success: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(success).alias("successes"), F.avg(F.when(success, F.col(value))).alias("avg_value")
    )


def storage_stats(snapshots: DataFrame) -> DataFrame:
    size = F.sum("content_length")
    return snapshots.agg(F.count("*").alias("objects"), size.alias("bytes"), (size / (1024.0 * 1024.0)).alias("megabytes"))


def result_summary(candidates: DataFrame, by: list[str]) -> DataFrame:
    ok = F.col("verification_status") == "verified"
    conf = combined_confidence("verification_status", "confidence_score", "verification_confidence")
    return candidates.groupBy(*by).agg(
        F.count("*").alias("total_candidates"),
        *[F.count_if(F.col("verification_status") == s).alias(s) for s in ("verified", "not_found", "failed")],
        rate(F.count_if(ok), F.count("*")).alias("verification_rate"),
        F.coalesce(F.avg(F.when(ok, conf)), F.lit(0.0)).alias("avg_combined_confidence"),
        F.countDistinct(F.when(ok, F.col("domain"))).alias("domains_verified"),
    )


def registry_stats(sources: DataFrame) -> DataFrame:
    facets = distributions(sources, ["province", "priority", "fetch_method", "enabled"])
    classes = sources.filter("enabled").select(F.explode("doc_classes").alias("value")).groupBy("value").agg(F.count("*").alias("count"))
    return facets.unionByName(classes.select(F.lit("doc_class").alias("facet"), "value", "count"))


def coverage_gap(sources: DataFrame, required: list[str] = vocab.DOC_CLASSES) -> DataFrame:
    """Per province: required document classes no enabled source covers."""
    need = F.array(*[F.lit(c) for c in sorted(required)])
    flags = {c: F.coalesce(F.bool_or(F.array_contains("doc_classes", F.lit(c))), F.lit(False)) for c in sorted(required)}
    out = sources.filter("enabled").groupBy("province").agg(
        F.count("*").alias("total_sources"), F.count_if(F.col("priority") == "high").alias("high_priority_sources"),
        F.array(*[F.when(~hit, F.lit(c)) for c, hit in flags.items()]).alias("_m"),
    )
    missing = F.array_intersect(need, F.filter("_m", lambda x: x.isNotNull()))
    return out.withColumn("missing_doc_classes", missing).withColumn("coverage_complete", F.size("missing_doc_classes") == 0).drop("_m")


def duplicate_report(rows: DataFrame, key: str = "domain") -> DataFrame:
    agg = rows.groupBy(key).agg(
        F.count("*").alias("entries"), (F.min("robots") != F.max("robots")).alias("robots_conflict"),
        (F.min("fetch_method") != F.max("fetch_method")).alias("fetch_conflict"),
    )
    return agg.filter("entries > 1")


def health_rollup(checks: DataFrame, by: list[str] = ()) -> DataFrame:
    """Worst status wins."""
    severity = F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    worst = F.max(severity)
    return checks.groupBy(*by).agg(
        F.when(worst == 2, "unhealthy").when(worst == 1, "degraded").otherwise("healthy").alias("overall_status"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("healthy", "degraded", "unhealthy")],
    )


def freshness(citations: DataFrame, sources: DataFrame, as_of: dt.datetime) -> DataFrame:
    stale = stale_sources(sources, as_of).agg(F.count("*").alias("n")).scalar()
    out = recent(citations, "created_at", 24, as_of).agg(
        F.count("*").alias("recent_citations"), F.max("created_at").alias("latest_citation")
    ).withColumn("stale_sources", stale)
    status = F.when(F.col("recent_citations") == 0, "stale").when(F.col("stale_sources") > 5, "degraded").otherwise("healthy")
    return out.withColumn("status", status)


def ontology_coverage(mappings: DataFrame, total: DataFrame, confidence: str = "overall_confidence") -> DataFrame:
    c = F.col(confidence)
    n = total.agg(F.count("*").alias("n")).scalar()
    return mappings.agg(
        F.count("*").alias("mapped"), F.avg(c).alias("avg_confidence"), F.count_if(c >= 0.7).alias("high"),
        F.count_if((c >= 0.4) & (c < 0.7)).alias("medium"), F.count_if(c < 0.4).alias("low"),
        *[F.countDistinct(x).alias(f"{x}s") for x in ("jurisdiction", "market_code", "asset_type")],
    ).withColumn("total_chunks", n).withColumn("unmapped", F.col("total_chunks") - F.col("mapped"))


def readiness(metrics: DataFrame, groundedness: float = 0.9, precision: float = 0.95, refusal: float = 0.99) -> DataFrame:
    """Label of the latest evaluation per province and document class."""
    g, p, r = (F.col(c) for c in ("groundedness_score", "citation_precision", "refusal_accuracy"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ready = (zero(g) >= groundedness) & (zero(p) >= precision) & (zero(r) >= refusal)
    evaluated = g.isNotNull() | p.isNotNull() | r.isNotNull()
    latest = topk_per_key(metrics, ["province", "doc_class"], [F.col("evaluation_date").desc()], 1, "_rn").drop("_rn")
    return latest.withColumn("readiness", F.when(ready, "ready").when(evaluated, "needs_improvement").otherwise("not_evaluated"))


def error_category(message: Column | str) -> Column:
    text = F.lower(F.col(message) if isinstance(message, str) else message)
    out = F
    for name, needles in vocab.ERROR_CATEGORIES:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(text, F.lit(needle))
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def error_histogram(logs: DataFrame) -> DataFrame:
    return logs.groupBy(error_category("message").alias("category")).agg(F.count("*").alias("count"))


def fetch_metrics(fetches: DataFrame, by: list[str]) -> DataFrame:
    """Success and duplicate rates and bytes; ``duplicate_of`` marks repeated content."""
    ok, n = F.count_if(F.col("http_status") == 200), F.count("*")
    return fetches.groupBy(*by).agg(
        n.alias("attempts"), ok.alias("successes"), rate(ok, n).alias("success_rate"),
        F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"),
        rate(F.count_if(F.col("duplicate_of").isNotNull()), n).alias("duplicate_rate"), F.sum("content_length").alias("bytes"),
    )


def with_format(fetches: DataFrame) -> DataFrame:
    return fetches.withColumn("document_format", doc_format("content_type"))


def stage_funnel(discovered: DataFrame, verified: DataFrame, ingested: DataFrame, key: str, by: str) -> DataFrame:
    """Distinct items per stage and the share that reached the next one."""
    def stage(df, name):
        return df.groupBy(by).agg(F.countDistinct(key).alias(name))

    out = stage(discovered, "discovered").join(stage(verified, "verified"), by, "left").join(stage(ingested, "ingested"), by, "left")
    out = out.fillna(0, ["verified", "ingested"])
    return out.withColumn("verification_rate", rate(F.col("verified"), F.col("discovered"))).withColumn(
        "ingestion_rate", rate(F.col("ingested"), F.col("verified"))
    )


def validate_answers(answers: DataFrame) -> DataFrame:
    """Pass or fail per answer: citations present, long enough, any expected keyword."""
    lowered = F.lower("answer_zh")
    hit = F.exists("expected_keywords", lambda k: F.contains(lowered, k))
    status = (
        F.when(F.col("citations_count") == 0, "No citations returned").when(F.length("answer_zh") < 50, "Answer too short")
        .when(~hit, "No expected keywords found")
    )
    return answers.withColumn("error", status).withColumn("status", F.when(status.isNull(), "passed").otherwise("failed"))


def validation_status(results: DataFrame) -> DataFrame:
    passed, failed = F.count_if(F.col("status") == "passed"), F.count_if(F.col("status") == "failed")
    return results.agg(passed.alias("tests_passed"), failed.alias("tests_failed")).withColumn(
        "status", F.when(F.col("tests_failed") == 0, "success").when(F.col("tests_passed") == 0, "failure").otherwise("partial_failure"))
