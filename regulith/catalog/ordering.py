"""Windows, top-k, ordered pages and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from regulith.catalog.base import ORDERS_AS_OF, query
from regulith.catalog.joins import case_any
from regulith.functions.scoring import jaccard_words
from regulith.operators import windows as w
from regulith.operators.scans import page
from regulith.plans.policy import topic_group
from regulith.sources import vocab


@query("w1_latest_per_key", "select query_fingerprint, pack_id from pack_v qualify row_number() over (partition by query_fingerprint order by created_at desc, pack_id desc) = 1")
def _(v):
    return w.latest_per_key(v("pack_v").select("query_fingerprint", "pack_id", "created_at"), ["query_fingerprint"], [F.col("created_at").desc(), F.col("pack_id").desc()]).drop("created_at")


@query("w2_topk_per_key", "select user_id, log_id, <<i:row_number() over (partition by user_id order by latency_ms desc nulls last, log_id)>> \"rank\" from query_log_v qualify \"rank\" <= 5")
def _(v):
    rows = v("query_log_v").select("user_id", "log_id", "latency_ms")
    return w.topk_per_key(rows, ["user_id"], [F.col("latency_ms").desc(), F.col("log_id")], 5).drop("latency_ms")


@query("w3_running_average", "select log_id, <<r:avg(latency_ms) over (partition by province order by created_at, log_id rows between unbounded preceding and current row)>> running_avg from query_log_v")
def _(v):
    rows = v("query_log_v").select("log_id", "province", "created_at", "latency_ms")
    return w.running_average(rows, ["province"], "created_at", "log_id", "latency_ms").select("log_id", "running_avg")


@query("w4_last_n", "select job_id, status from ocr_job_v order by finished_at desc, job_id desc limit 1000")
def _(v):
    return w.last_n(v("ocr_job_v").select("job_id", "status", "finished_at"), "finished_at", "job_id").select("job_id", "status")


@query("w5_cumulative_offsets", """select conv_id, turn, <<i:coalesce(sum(length(text)) over p, 0)>> start_char, <<i:coalesce(sum(length(text)) over p, 0) + length(text)>> end_char
 from conversations window p as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)""")
def _(v):
    return w.cumulative_offsets(v("conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "start_char", "end_char")


@query("w6_with_ordinal", "select doc_id, unnest(parts) item, <<i:unnest(range(1, len(parts) + 1))>> ordinal from (select doc_id, string_split(text, chr(10)) parts from documents)")
def _(v):
    docs = v("documents").select("doc_id", F.split("text", "\n").alias("parts"))
    return w.with_ordinal(docs, "parts", ["doc_id"])


@query("w7_share_of_total", "select code, count(*) \"count\", <<r:count(*) / (select count(*) from refusal_v)>> share from refusal_v group by 1")
def _(v):
    return w.share_of_total(v("refusal_v").groupBy("code").agg(F.count("*").alias("count")), "count")


@query("w8_first_seen", "select checksum, arg_min(page_id, fetched_at) first_id from snapshot_v group by 1")
def _(v):
    from regulith.operators.joins import first_seen

    return first_seen(v("snapshot_v"), "checksum", "page_id", "fetched_at")


@query("w9_first_match", "select citation_id, " + case_any("lower(content)", vocab.ANSWER_TOPICS, vocab.ANSWER_REST) + " topic, " + case_any("lower(content) || ' ' || lower(title)", vocab.PACK_TOPICS, vocab.PACK_REST) + " pack_topic from citation_zh_v")
def _(v):
    return topic_group(topic_group(v("citation_zh_v"), vocab.ANSWER_TOPICS, vocab.ANSWER_REST, ["content"], "topic"),
                       vocab.PACK_TOPICS, vocab.PACK_REST, ["content", "title"], "pack_topic").select("citation_id", "topic", "pack_topic")


@query("w10_superseded_map", """select citation_id old_id, new_id from (select *, first_value(citation_id) over (partition by checksum order by effective_date desc, doc_id desc) new_id from citation_base) where citation_id <> new_id""")
def _(v):
    return w.superseded_map(v("citation_base"), ["checksum"], ties=["doc_id"])


@query("k1_latest_citations", "select citation_id, <<d:effective_date>> effective_date from citation_base order by effective_date desc, citation_id limit 25")
def _(v):
    return w.latest_citations(v("citation_base"), 25).select("citation_id", "effective_date")


@query("k3_page_signals", "select signal_id, <<r:relevance_score>> relevance_score from signal_v order by relevance_score desc, published_date desc, signal_id limit 20 offset 40")
def _(v):
    return w.page_signals(v("signal_v"), 20, 40).select("signal_id", "relevance_score")


@query("k3_deep_page", "select l_orderkey, l_linenumber, <<r:l_extendedprice>> l_extendedprice, 50000 + row_number() over () position from (select * from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 50 offset 50000)")
def _(v):
    """A page far down a large table."""
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    rows = v("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return page(rows, order, 50, 50_000).select("l_orderkey", "l_linenumber", "l_extendedprice", "position")


@query("k5_upcoming_deadlines", "select signal_id, <<d:deadline_date>> deadline_date from signal_v where deadline_date <= date '1998-07-01' and deadline_date >= date '1998-06-01' order by deadline_date, signal_id limit 5")
def _(v):
    return w.upcoming_deadlines(v("signal_v"), ORDERS_AS_OF.date(), lower=ORDERS_AS_OF.date()).select("signal_id", "deadline_date")


@query("k6_top_codes", "select code, count(*) \"count\", <<r:count(*) / (select count(*) from refusal_v)>> share from refusal_v group by 1 order by 2 desc, 1 limit 5")
def _(v):
    return w.top_codes(v("refusal_v"))


@query("k7_order_by_rank", "select domain, case priority when 'urgent' then 0 when 'high' then 1 when 'medium' then 2 else 3 end::bigint priority_rank from source_v")
def _(v):
    return w.order_by_rank(v("source_v")).select("domain", "priority_rank")


@query("k8_pending_jobs", "select job_id from job_v where job_status = 'pending' and job_type = 'ocr' order by scheduled_at, job_id limit 100")
def _(v):
    return w.pending_jobs(v("job_v"), "ocr").select("job_id")


@query("k9_best_candidates", "select candidate_id from candidate_v order by confidence_score desc, candidate_id limit 15")
def _(v):
    return w.best_candidates(v("candidate_v"), 15).select("candidate_id")


@query("k10_list_requests", "select request_id from request_v where status = 'submitted' and priority = 'high' order by submitted_at desc, request_id limit 50")
def _(v):
    return w.list_requests(v("request_v"), "submitted", "high").select("request_id")


@query("k11_best_match", "select user_id, log_id, <<r:latency_ms / 10000.0>> score from query_log_v where latency_ms / 10000.0 >= 0.3 qualify row_number() over (partition by user_id order by latency_ms desc, log_id) = 1")
def _(v):
    rows = v("query_log_v").select("user_id", "log_id", (F.col("latency_ms") / 10000.0).alias("score"))
    return w.best_match(rows, "user_id", "score", "log_id")


@query("u1_domain_allowlist", "select domain from source_v union select domain from allow_v")
def _(v):
    return w.domain_allowlist(v("source_v"), v("allow_v"))


@query("u2_union_preferred", """select url, candidate_id, <<i:source_rank>> source_rank from (select url, candidate_id, 0 source_rank from candidate_v where confidence_score >= 0.5 union all select url, candidate_id, 1 from candidate_v)
 qualify row_number() over (partition by url order by source_rank, candidate_id) = 1""")
def _(v):
    c = v("candidate_v").select("url", "candidate_id", "confidence_score")
    return w.union_preferred(c.filter("confidence_score >= 0.5"), c, "url", "candidate_id").select("url", "candidate_id", "source_rank")


@query("u3_difference", "select distinct domain from source_v where domain not in (select domain from allow_v)")
def _(v):
    return w.difference(v("source_v").select("domain"), v("allow_v"), "domain")


WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda x: length(x) > 0))"


@query("u4_token_overlap", f"select conv_id, turn, <<r:case when len(u) = 0 then 0 else len(list_intersect(a, b)) / len(u) end>> similarity from (select *, list_distinct(list_concat(a, b)) u from (select l.conv_id, l.turn, {WORDS.replace('{c}', 'l.text')} a, {WORDS.replace('{c}', 'r.text')} b from conversations l join conversations r on l.conv_id = r.conv_id and r.turn = l.turn + 1))")
def _(v):
    c = v("conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", jaccard_words("text", "next_text").alias("similarity"))


@query("u5_all_sources", "select domain, province from source_v")
def _(v):
    src = v("source_v").select("domain", "province")
    return w.all_sources(*[src.filter(F.col("province") == p) for p in vocab.PROVINCES])
