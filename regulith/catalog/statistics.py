"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from regulith.catalog.base import AS_OF, ORDERS_AS_OF, query
from regulith.operators import aggregates as a
from regulith.operators import windows as w
from regulith.operators.joins import mark_duplicates


def facets_sql(source: str, names: list[str], fill: str | None = None) -> str:
    """One union branch per facet."""
    parts = []
    for n in names:
        value = f"coalesce(cast({n} as varchar), '{fill}')" if fill else f"cast({n} as varchar)"
        parts.append(f"select '{n}' facet, {value} \"value\", count(*) \"count\" from {source} where {value} is not null group by 2")
    return " union all ".join(parts)


@query("a1_coverage", "select province, doc_class, count(*) citation_count, <<d:min(effective_date)>> earliest_date, <<d:max(effective_date)>> latest_date from citation_vec group by 1, 2")
def _(v):
    return a.coverage(v("citation_vec"))


@query("a2_coverage_cube", """select province, doc_class, <<i:grouping(province, doc_class)>> grain, count(*) citation_count, <<d:min(effective_date)>> earliest_date,
 <<d:max(effective_date)>> latest_date from citation_vec group by cube (province, doc_class)""")
def _(v):
    return a.coverage_cube(v("citation_vec"))


@query("a3_embedding_stats", "select province, count(*) \"count\", count(distinct citation_id) citations, <<r:count(*) / (select count(*) from citation_vec)>> share from citation_vec group by 1")
def _(v):
    return a.embedding_stats(v("citation_vec"), "province")


@query("a4_query_stats", """select count(*) total_queries, count(*) filter (verdict = 'ok') ok_queries, count(*) filter (verdict = 'refused') refused_queries,
 count(*) filter (verdict = 'error') error_queries, <<r:count(*) filter (verdict = 'refused') / count(*)>> refusal_rate,
 <<r:count(*) filter (verdict = 'error') / count(*)>> error_rate, <<r:avg(latency_ms)>> avg_latency_ms
 from query_log_v where created_at >= timestamp '2024-01-30 00:00:00' - interval '240' hour and province = 'guangdong'""")
def _(v):
    return a.query_stats(v("query_log_v"), AS_OF, 240, "guangdong")


@query("a5_query_distribution", facets_sql("query_log_v", ["province", "doc_class", "asset"], "none"))
def _(v):
    return a.query_distribution(v("query_log_v"))


@query("a6_signal_stats", facets_sql("signal_v", ["signal_type", "priority", "province", "asset_type"]) + """
 union all select 'summary', 'total', count(*) from signal_v union all select 'summary', 'recent', count(*) from signal_v where published_date >= date '1998-05-02'
 union all select 'summary', 'due', count(*) from signal_v where deadline_date <= date '1998-07-01'""")
def _(v):
    return a.signal_stats(v("signal_v"), ORDERS_AS_OF.date())


@query("a7_request_stats", facets_sql("request_v", ["status", "priority", "refusal_code"]))
def _(v):
    return a.request_stats(v("request_v"))


@query("a8_refusal_stats", facets_sql("refusal_v", ["code", "province", "doc_class", "asset"]))
def _(v):
    return a.refusal_stats(v("refusal_v"))


@query("a8_refusal_rate", "select count(*) total_refusals, <<r:count(*) / (select count(*) from query_log_v)>> refusal_rate from refusal_v")
def _(v):
    return a.refusal_rate(v("refusal_v"), v("query_log_v"))


@query("a9_job_stats", facets_sql("job_v", ["job_type", "job_status"]) + """ union all select 'summary', 'total', count(*) from job_v
 union all select 'summary', 'pending', count(*) from job_v where job_status = 'pending' union all select 'summary', 'running', count(*) from job_v where job_status = 'processing'
 union all select 'summary', 'recent', count(*) from job_v where scheduled_at >= timestamp '1998-05-31 00:00:00'""")
def _(v):
    return a.job_stats(v("job_v"), ORDERS_AS_OF)


@query("a10_dedup_first", "select checksum, <<i:min(page_id)>> page_id from snapshot_v group by 1")
def _(v):
    return w.dedup_first(v("snapshot_v").select("checksum", "page_id"), ["checksum"], [F.col("page_id")])


@query("a10_dedup_documents", "select checksum, <<i:min(doc_id)>> doc_id from citation_base group by 1")
def _(v):
    return w.dedup_first(v("citation_base").select("checksum", "doc_id"), ["checksum"], [F.col("doc_id")])


@query("a11_pack_summary", """select s.*, t.sources from (select pack_id, count(*) total_citations, count(distinct province) unique_provinces, count(distinct asset) unique_assets,
 count(distinct doc_class) unique_doc_classes, count(distinct source_url) unique_sources, <<d:min(effective_date)>> earliest, <<d:max(effective_date)>> latest,
 <<r:avg(confidence_score)>> avg_confidence, <<r:min(confidence_score)>> min_confidence, <<r:max(confidence_score)>> max_confidence from pack_citation_v group by 1) s
 join (select pack_id, string_agg(source_url, ',' order by source_url) sources from (select *, row_number() over (partition by pack_id order by source_url) rn
 from (select distinct pack_id, source_url from pack_citation_v)) where rn <= 10 group by 1) t using (pack_id)""")
def _(v):
    return a.pack_summary(v("pack_citation_v"))


@query("a13_ocr_metrics", """select province, count(*) total_jobs, count(*) filter (status = 'success') successful_jobs, count(*) filter (status = 'failed') failed_jobs,
 count(*) filter (status = 'partial') partial_jobs, <<i:sum(pages_processed)>> total_pages, <<i:sum(tables_extracted)>> total_tables,
 <<r:count(*) filter (status = 'success') / count(*)>> success_rate, <<r:count(*) filter (effective_date_found) / count(*)>> date_hit_rate,
 <<r:avg(processing_time_ms) filter (status = 'success')>> avg_processing_time_ms, <<r:avg(pages_processed)>> pages_per_job, <<r:avg(tables_extracted)>> tables_per_job
 from ocr_job_v group by 1""")
def _(v):
    return a.ocr_metrics(v("ocr_job_v"), ["province"])


@query("a14_latency_percentiles", """select verdict, <<i:count(*)>> n, <<r:quantile_cont(latency_ms, 0.5)>> p50, <<r:quantile_cont(latency_ms, 0.95)>> p95, <<r:quantile_cont(latency_ms, 0.99)>> p99
 from query_log_v where latency_ms <> 0 group by 1""")
def _(v):
    return a.latency_percentiles(v("query_log_v"), "latency_ms", ["verdict"])


@query("a15_slo_report", """select *, success_rate_met and date_hit_rate_met and p95_met overall_met from (select *, success_rate >= 0.95 success_rate_met,
 date_hit_rate >= 0.8 date_hit_rate_met, p95_processing_time_ms <= 12000 p95_met from (select province, <<r:count(*) filter (status = 'success') / count(*)>> success_rate,
 <<r:count(*) filter (effective_date_found) / count(*)>> date_hit_rate, <<r:avg(processing_time_ms) filter (status = 'success')>> avg_processing_time_ms,
 <<r:quantile_cont(processing_time_ms, 0.95) filter (processing_time_ms <> 0)>> p95_processing_time_ms from ocr_job_v group by 1))""")
def _(v):
    return a.slo_report(v("ocr_job_v"), by=["province"])


@query("a16_success_average", "select doc_class, count(*) total, count(*) filter (verdict = 'ok') successes, <<r:avg(latency_ms) filter (verdict = 'ok')>> avg_value from query_log_v group by 1")
def _(v):
    return a.success_average(v("query_log_v"), "latency_ms", F.col("verdict") == "ok", ["doc_class"])


@query("a17_storage_stats", "select count(*) objects, <<i:sum(content_length)>> bytes, <<r:sum(content_length) / 1048576.0>> megabytes from snapshot_v")
def _(v):
    return a.storage_stats(v("snapshot_v"))


@query("a18_result_summary", """select province, count(*) total_candidates, count(*) filter (verification_status = 'verified') verified,
 count(*) filter (verification_status = 'not_found') not_found, count(*) filter (verification_status = 'failed') failed,
 <<r:count(*) filter (verification_status = 'verified') / count(*)>> verification_rate,
 <<r:coalesce(avg(confidence_score * 0.3 + verification_confidence * 0.7) filter (verification_status = 'verified'), 0)>> avg_combined_confidence,
 count(distinct domain) filter (verification_status = 'verified') domains_verified from candidate_v group by 1""")
def _(v):
    return a.result_summary(v("candidate_v"), ["province"])


@query("a19_registry_stats", facets_sql("source_v", ["province", "priority", "fetch_method", "enabled"]) +
       " union all select 'doc_class', c, count(*) from (select unnest(doc_classes) c from source_v where enabled) group by 2")
def _(v):
    return a.registry_stats(v("source_v"))


@query("a20_coverage_gap", """select province, total_sources, high_priority_sources, <<a:missing>> missing_doc_classes, len(missing) = 0 coverage_complete
 from (select province, count(distinct domain) total_sources, count(distinct domain) filter (priority = 'high') high_priority_sources,
 list_filter(['dispatch_ops', 'grid_connection', 'market_rules'], lambda x: not list_contains(list(c), x)) missing
 from (select province, domain, priority, unnest(doc_classes) c from source_v where enabled) group by 1)""")
def _(v):
    return a.coverage_gap(v("source_v"))


@query("a21_duplicate_report", """select domain, count(*) entries, count(distinct robots) > 1 robots_conflict, count(distinct fetch_method) > 1 fetch_conflict
 from source_row_v group by 1 having count(*) > 1""")
def _(v):
    return a.duplicate_report(v("source_row_v"))


HEALTH = "case verdict when 'error' then 'unhealthy' when 'refused' then 'degraded' else 'healthy' end"


@query("a22_health_rollup", f"""select user_id, case when max(s) = 2 then 'unhealthy' when max(s) = 1 then 'degraded' else 'healthy' end overall_status, count(*) filter (s = 0) healthy,
 count(*) filter (s = 1) degraded, count(*) filter (s = 2) unhealthy from (select user_id, case verdict when 'error' then 2 when 'refused' then 1 else 0 end s from query_log_v) group by 1""")
def _(v):
    return a.health_rollup(v("query_log_v").withColumn("status", F.expr(HEALTH)), ["user_id"])


@query("a23_freshness", """select *, case when recent_citations = 0 then 'stale' when stale_sources > 5 then 'degraded' else 'healthy' end status from (select count(*) recent_citations, <<t:max(created_at)>> latest_citation,
 (select count(*) from source_v where enabled and (last_crawled_at is null or last_crawled_at < timestamp '2024-01-28 00:00:00')) stale_sources
 from citation_base where created_at >= timestamp '2024-01-29 00:00:00')""")
def _(v):
    return a.freshness(v("citation_base"), v("source_v"), AS_OF)


@query("a26_readiness", """select province, doc_class, <<d:evaluation_date>> evaluation_date, case when coalesce(groundedness_score, 0) >= 0.5 and coalesce(citation_precision, 0) >= 0.6
 and coalesce(refusal_accuracy, 0) >= 0.5 then 'ready' when coalesce(groundedness_score, citation_precision, refusal_accuracy) is not null then 'needs_improvement' else 'not_evaluated' end readiness
 from metric_v qualify row_number() over (partition by province, doc_class order by evaluation_date desc) = 1""")
def _(v):
    return a.readiness(v("metric_v"), 0.5, 0.6, 0.5).select("province", "doc_class", "evaluation_date", "readiness")


@query("a27_error_histogram", """select case when contains(lower(message), 'no_citations') then 'no_citations' when contains(lower(message), 'policy') or contains(lower(message), 'guardrails') then 'policy_violation'
 when contains(lower(message), 'composition') then 'composition_failed' when contains(lower(message), 'retrieval') then 'retrieval_failed' when contains(lower(message), 'internal') then 'internal_error'
 else 'unknown' end category, count(*) "count" from error_v group by 1""")
def _(v):
    return a.error_histogram(v("error_v"))


@query("a29_fetch_metrics", """select domain, document_format, count(*) attempts, count(*) filter (http_status = 200) successes, <<r:count(*) filter (http_status = 200) / count(*)>> success_rate,
 count(duplicate_of) duplicates, <<r:count(duplicate_of) / count(*)>> duplicate_rate, <<i:sum(content_length)>> bytes from (select *,
 case when lower(content_type) like '%text/html%' then 'html' when lower(content_type) like '%application/pdf%' then 'pdf' else 'unknown' end document_format,
 nullif(first_value(page_id) over (partition by checksum order by fetched_at, page_id), page_id) duplicate_of from snapshot_v) group by 1, 2""")
def _(v):
    return a.fetch_metrics(a.with_format(mark_duplicates(v("snapshot_v"))), ["domain", "document_format"])


@query("a30_stage_funnel", """select province, discovered, verified, ingested, <<r:verified / discovered>> verification_rate, <<r:case when verified = 0 then 0 else ingested / verified end>> ingestion_rate from (
 select province, count(distinct url) discovered, count(distinct url) filter (verification_status = 'verified') verified,
 count(distinct url) filter (verification_status = 'verified' and http_status = 200) ingested from candidate_v group by 1)""")
def _(v):
    c = v("candidate_v")
    ok = c.filter("verification_status = 'verified'")
    return a.stage_funnel(c, ok, ok.filter("http_status = 200"), "url", "province")


@query("a31_validate_answers", """select citation_id, case when doc_id % 10 = 0 then 'No citations returned' when length(content) < 50 then 'Answer too short'
 when not (contains(lower(content), 'the') or contains(lower(content), 'ouz')) then 'No expected keywords found' end error,
 case when doc_id % 10 <> 0 and length(content) >= 50 and (contains(lower(content), 'the') or contains(lower(content), 'ouz')) then 'passed' else 'failed' end status from citation_base""")
def _(v):
    answers = v("citation_base").select("citation_id", F.col("content").alias("answer_zh"), F.when(F.col("doc_id") % 10 == 0, 0).otherwise(2).alias("citations_count"),
                                        F.array(F.lit("the"), F.lit("ouz")).alias("expected_keywords"))
    return a.validate_answers(answers).select("citation_id", "error", "status")


@query("a31_validation_status", "select count(*) filter (doc_id % 10 <> 0) tests_passed, count(*) filter (doc_id % 10 = 0) tests_failed, 'partial_failure' status from citation_base")
def _(v):
    return a.validation_status(v("citation_base").select(F.when(F.col("doc_id") % 10 == 0, "failed").otherwise("passed").alias("status")))
