"""Validation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from regulith.catalog.base import query
from regulith.catalog.scalar import AN, CJK, n_of
from regulith.operators import validation as val

TODAY = dt.date(2026, 1, 1)


def codes(**rules: str) -> str:
    """Violated rules in order, joined by commas."""
    return "concat_ws(',', " + ", ".join(f"case when {bad} then '{code}' end" for code, bad in rules.items()) + ") errors"


@query("v1_validate_citations", "select citation_id, " + codes(title="doc_id % 7 = 0", url="doc_id % 11 = 0", url_domain="doc_id % 11 = 0", checksum="doc_id % 5 = 0", date_future="effective_date > date '2025-06-01'",
                                                              date_old="effective_date < date '2015-06-04'") + " from citation_base")
def _(v):
    c = v("citation_base").withColumns({
        "title": F.when(F.col("doc_id") % 7 == 0, F.repeat(F.lit("x"), 501)).otherwise(F.col("title")),
        "url": F.when(F.col("doc_id") % 11 == 0, F.lit("ftp://nowhere")).otherwise(F.col("url")),
        "checksum": F.when(F.col("doc_id") % 5 == 0, F.lit("abc")).otherwise(F.col("checksum"))})
    return val.validate_citations(c, dt.date(2025, 6, 1)).select("citation_id", "errors")


@query("v2_validate_queries", "select question_id, " + codes(asset="asset is null", question_short="length(trim(question)) < 3", question_long="length(trim(question)) > 500", limit="conv_id % 30 = 0 or conv_id % 30 > 20") + " from question_v")
def _(v):
    return val.validate_queries(v("question_v").withColumn("k", F.col("conv_id") % 30)).select("question_id", "errors")


@query("v3_validate_embeddings", "select vec_id, " + codes(dimension="vec_id % 4 = 0", out_of_range="vec_id % 4 <> 0 and vec_id % 6 = 1") + " from embeddings")
def _(v):
    e = F.when(F.col("vec_id") % 4 == 0, F.slice("embedding", 1, 60)).when(F.col("vec_id") % 6 == 1, F.transform("embedding", lambda x: x * 1000000)).otherwise(F.col("embedding"))
    return val.validate_embeddings(v("embeddings").withColumn("embedding", e), 64).select("vec_id", "errors")


@query("v4_validate_chinese", "select citation_id, " + codes(low_ratio=f"{n_of('content', CJK)} / nullif({n_of('content', AN)}, 0) < 0.1") + " from citation_zh_v")
def _(v):
    return val.validate_chinese(v("citation_zh_v"), min_ratio=0.1).select("citation_id", "errors")


@query("v5_validate_registry", """select 'warning' severity, domain subject, 'not an official domain' message from source_v union all select 'warning', domain, 'high priority source is disabled' from source_v where priority = 'high' and not enabled
 union all select 'warning', domain, 'infrequent crawling' from source_v where cadence like '%P9D' union all select 'warning', province, 'missing ' || array_to_string(missing, ',') from (select province,
 list_filter(['dispatch_ops', 'grid_connection', 'market_rules'], lambda x: not list_contains(list(c), x)) missing from (select province, unnest(doc_classes) c from source_v where enabled) group by 1) where len(missing) > 0
 union all select 'warning', province, 'no high priority source' from (select province, count(*) filter (priority = 'high') n from source_v where enabled group by 1) where n = 0""")
def _(v):
    return val.validate_registry(v("source_v"))


@query("v6_validate_snapshots", "select page_id, " + codes(empty="page_id % 9 = 0", checksum="page_id % 9 = 0 or page_id % 4 = 1", length="page_id % 9 = 0 and content_length <> 0") + " from snapshot_v")
def _(v):
    s = v("snapshot_v").withColumns({
        "content": F.when(F.col("page_id") % 9 == 0, F.lit("")).otherwise(F.col("content")),
        "checksum": F.when(F.col("page_id") % 4 == 1, F.sha2("original_url", 256)).otherwise(F.col("checksum"))})
    return val.validate_snapshots(s).select("page_id", "errors")


def constraints(source: str, **rules: str) -> str:
    return " union all ".join(f"select '{n}' \"constraint\", count(*) filter (not ({ok})) violations, count(*) \"rows\" from {source}" for n, ok in rules.items())


@query("v7_log_constraints", constraints("query_log_v", verdict="verdict in ('ok', 'refused', 'error')", latency="latency_ms >= 0"))
def _(v):
    return val.constraint_report(v("query_log_v"), **val.log_constraints())


@query("v7_citation_constraints", constraints("citation_base", doc_class="doc_class in ('market_rules', 'grid_connection', 'dispatch_ops')", asset="asset in ('wind', 'solar', 'bess', 'coal_flex')"))
def _(v):
    return val.constraint_report(v("citation_base"), **val.citation_constraints())


@query("v7_job_constraints", constraints("job_v", job_status="job_status in ('pending', 'processing', 'completed', 'failed', 'retrying')", job_type="job_type in ('discovery', 'verification', 'ingestion', 'ocr', 'normalization')"))
def _(v):
    return val.constraint_report(v("job_v"), **val.job_constraints())


@query("v7_metric_constraints", constraints("metric_v", groundedness_score="groundedness_score between 0 and 1", citation_precision="citation_precision between 0 and 1", refusal_accuracy="refusal_accuracy between 0 and 1"))
def _(v):
    return val.constraint_report(v("metric_v"), **val.metric_constraints())
