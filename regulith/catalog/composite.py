"""End-to-end batches and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from regulith.catalog import fold_sql as q
from regulith.catalog.base import AS_OF, query
from regulith.catalog.ontology import map_sql
from regulith.catalog.policy import compose_sql
from regulith.catalog.retrieval import HYBRID, stored
from regulith.catalog.scalar import strip_sql
from regulith.catalog.texts import CHUNK_ID, LAYOUT_PARAS, ZH_TEXT, layout_docs
from regulith.operators.aggregates import ocr_metrics
from regulith.operators.filters import SignalFilter
from regulith.plans import answers, ingest, quality
from regulith.plans.ontology import Thresholds

ALL_HOSTS = lambda v: v("documents").select(F.concat("source", F.lit(".gov.cn")).alias("domain")).distinct()


def _batch(v):
    packs = v("pack_v").withColumn("query_fingerprint", F.substring("query_fingerprint", 1, 16))
    nothing = ALL_HOSTS(v).filter("domain = 'none'")
    asks, cites = stored(v, "question_vec", "citation_emb_v")
    return answers.answer_batch(asks, cites, packs, ALL_HOSTS(v), nothing, AS_OF)


@query("x24_answer_batch", f"""with {HYBRID}, res as (select h.question_id, h.citation_id, h."rank", c.title, c.effective_date, c.content from hybrid h join act c using (citation_id)), {compose_sql('res', 'question_vec')}
 select question_id, answer_zh, refusal_reason, sections, total_citations from composed""")
def _(v):
    return _batch(v).answers.select("question_id", "answer_zh", "refusal_reason", "sections", "total_citations")


SHORT = f"substr(sha256(concat_ws(':', province, doc_class, coalesce(asset, 'none'), lower({strip_sql('question')}))), 1, 16)"


@query("x24_answer_packs", f"""with {HYBRID} select {SHORT} query_fingerprint, q.province, q.doc_class, q.asset, string_agg(h.citation_id, ',' order by h."rank") citation_ids, 'generated' pack_status
 from question_vec q join (select * from hybrid where "rank" <= 10) h using (question_id) group by q.question_id, q.question, q.province, q.doc_class, q.asset""")
def _(v):
    """The new packs of a batch."""
    return _batch(v).packs.select("query_fingerprint", "province", "doc_class", "asset", "citation_ids", "pack_status")


HITS = f"""usable as (select * from pack_fresh_v where pack_status = 'generated' and created_at >= timestamp '2024-01-29 00:00:00' qualify row_number() over (partition by query_fingerprint order by created_at desc, pack_id desc) = 1),
 hit_q as (select f.question_id, u.* from (select question_id, {SHORT} fp from question_vec) f join usable u on u.query_fingerprint = f.fp)"""


@query("x24_answer_cached", f"""with {HYBRID}, {HITS}, res as (select h.question_id, h.citation_id, h."rank", c.title, c.effective_date, c.content from hybrid h join act c using (citation_id)), {compose_sql('res', 'question_vec')}
 select question_id, answer_zh, refusal_reason, sections, total_citations, case when refusal_reason is null then 'ok' else 'refused' end verdict, false from_cache from composed where question_id not in (select question_id from hit_q)
 union all select question_id, answer_zh, null, 0, 2, 'ok', true from hit_q""")
def _(v):
    """Questions whose fingerprint has a fresh pack take its answer; the others are answered."""
    nothing = ALL_HOSTS(v).filter("domain = 'none'")
    t = answers.answer_batch(*stored(v, "question_vec", "citation_emb_v"), v("pack_fresh_v"), ALL_HOSTS(v), nothing, AS_OF)
    return t.answers.select("question_id", "answer_zh", "refusal_reason", "sections", "total_citations").join(t.logs.select("question_id", "verdict", "from_cache"), "question_id")


ASSETS = f"{map_sql('province')}, best as (select * from mapped where \"rank\" = 1)"
NEW_ID = r"regexp_replace(substr(sha256(url || ':' || sha256(content)), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')"
MADE = f"""paras as (select * from {LAYOUT_PARAS}), {q.chunks('paras', 200, 40, 10)},
 made as (select doc_id, count(*) n from chunk group by doc_id),
 job as (select z.doc_id job_id, case when len(paragraphs) = 0 then '{ingest.NO_CONTENT}' when made.n is null then '{ingest.NO_CHUNKS}' end error, dd is not null effective_date_found, coalesce(made.n, 0) chunks
  from citation_zh_v z join paras using (doc_id) left join made using (doc_id) left join dd using (doc_id))"""


def _ingested(v):
    old = v("citation_base").select("citation_id", "province", "doc_class", "asset", "title", "url", "effective_date", "checksum", "content")
    low = Thresholds(jurisdiction=0.1, market=0.05, asset=0.05, overall=0.05, fuzzy=None, per_level=2, max_mappings=5)
    return ingest.ingest_batch(layout_docs(v), old, AS_OF, thresholds=low, max_tokens=200, overlap=40, min_clause=10)


@query("x25_ingest_changes", "select * from (select 'kept' change, count(*) \"count\" from citation_base union all select 'inserted', count(*) from citation_zh_v)")
def _(v):
    return _ingested(v).changes


@query("x25_ingest_citations", f"""with {q.dates(ZH_TEXT)}, {ASSETS} select citation_id, asset, <<d:effective_date>> effective_date, checksum, 'kept' change from citation_base
 union all select {NEW_ID} citation_id, best.asset_type asset, <<d:dd.dd>> effective_date, sha256(content) checksum, 'inserted' change from citation_zh_v z left join dd using (doc_id) left join best on best.citation_id = z.citation_id""".replace("{NEW_ID}", NEW_ID))
def _(v):
    return _ingested(v).citations.select("citation_id", "asset", "effective_date", "checksum", "change")


@query("x25_embedding_input", f"""with {MADE.replace('dd is not null', 'true').replace(' left join dd using (doc_id)', '')} select {NEW_ID.replace('content', 'z.content')} citation_id, {CHUNK_ID} chunk_id, regexp_replace({strip_sql('chunk.content')}, '\\s+', ' ', 'g') "text", 'text-embedding' model, 768 "dimension", z.province, z.doc_class
 from chunk join citation_zh_v z using (doc_id)""")
def _(v):
    return _ingested(v).embedding_input


@query("x25_ingest_jobs", f"""with {q.dates(ZH_TEXT)}, {MADE} select job_id, case when error is null then 'success' else 'failed' end status, error, 1 pages_processed, 1 tables_extracted, effective_date_found, chunks from job""")
def _(v):
    return _ingested(v).jobs.drop("citation_id", "processing_time_ms")


@query("x25_job_metrics", f"""with {q.dates(ZH_TEXT)}, {MADE} select count(*) total_jobs, count(*) filter (error is null) successful_jobs, count(*) filter (error is not null) failed_jobs, 0 partial_jobs, count(*) total_pages, count(*) total_tables,
 <<r:count(*) filter (error is null) / count(*)>> success_rate, <<r:count(*) filter (effective_date_found) / count(*)>> date_hit_rate, cast(null as double) avg_processing_time_ms, 1e0 pages_per_job, 1e0 tables_per_job from job""")
def _(v):
    """Jobs of the ingest in the report of processing jobs."""
    return ocr_metrics(_ingested(v).jobs)


GOLD = """g as (select item_id question_id, text clause, 'c' || cast(item_id + item_id % 2 as varchar) expected_citation, item_id % 4 = 0 should_refuse from benchmark),
 ans as (select doc_id question_id, province, doc_class, case when doc_id % 5 = 0 then 'refused' else 'ok' end verdict, content answer_zh, citation_id from citation_base)"""
GATES = """select t.*, p95_latency_ms, groundedness_score, refusal_accuracy, citation_precision from (select province, doc_class, count(*) total_queries, count(*) filter (verdict = 'ok') passed_queries, count(*) filter (verdict = 'refused') refused_queries, avg(latency_ms) avg_latency_ms,
  quantile_cont(latency_ms, 0.95) filter (latency_ms <> 0) p95_latency_ms from query_log_v group by 1, 2) t left join (select province, doc_class, count(*) filter (contains(answer_zh, clause)) / count(*) groundedness_score,
  count(*) filter (should_refuse and verdict = 'refused') / nullif(count(*) filter (should_refuse), 0) refusal_accuracy from g join ans using (question_id) group by 1, 2) using (province, doc_class)
 left join (select province, doc_class, count(*) filter (ans.citation_id = g.expected_citation) / count(*) citation_precision from ans join g using (question_id) group by 1, 2) using (province, doc_class)"""


def _gold(v):
    gold = v("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("clause"), F.concat(F.lit("c"), (F.col("item_id") + F.col("item_id") % 2).cast("string")).alias("expected_citation"), (F.col("item_id") % 4 == 0).alias("should_refuse"))
    ans = v("citation_base").select(F.col("doc_id").alias("question_id"), "province", "doc_class", F.when(F.col("doc_id") % 5 == 0, "refused").otherwise("ok").alias("verdict"), F.col("content").alias("answer_zh"), "citation_id")
    return ans, gold


@query("a25_quality_metrics", f"with {GOLD} select province, doc_class, total_queries, passed_queries, refused_queries, <<r:avg_latency_ms>> avg_latency_ms, <<r:p95_latency_ms>> p95_latency_ms, <<r:groundedness_score>> groundedness_score, <<r:refusal_accuracy>> refusal_accuracy, <<r:citation_precision>> citation_precision from ({GATES})")
def _(v):
    return quality.quality_metrics(v("query_log_v"), *_gold(v))


@query("x29_quality_gates", f"""with {GOLD} select province, doc_class, case when coalesce(groundedness_score, 0) >= 0.05 and coalesce(citation_precision, 0) >= 0.3 and coalesce(refusal_accuracy, 0) >= 0.2 then 'ready'
 when coalesce(groundedness_score, citation_precision, refusal_accuracy) is not null then 'needs_improvement' else 'not_evaluated' end readiness from ({GATES})""")
def _(v):
    return quality.quality_gates(v("query_log_v"), *_gold(v), "2024-01-30", groundedness=0.05, precision=0.3, refusal=0.2).select("province", "doc_class", "readiness")


@query("x30_signals_report", """with hits as (select * from signal_v where province in ('ASIA', 'EUROPE') and (contains(lower(title), 'high') or contains(lower(content), 'high') or len(list_filter(tags, lambda t: contains(lower(t), 'high'))) > 0) and impact_score >= 0.1)
 select signal_id, <<r:relevance_score>> relevance_score, (select count(*) from hits) total_count from hits order by relevance_score desc, published_date desc, signal_id limit 25 offset 10""")
def _(v):
    flt = SignalFilter(provinces=["ASIA", "EUROPE"], keywords="HIGH", min_impact_score=0.1)
    return quality.signals_report(v("signal_v"), flt, 25, 10).select("signal_id", "relevance_score", "total_count")
