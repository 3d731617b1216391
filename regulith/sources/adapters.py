"""Views that give the shared test tables the shape of regulation data.

One SQL text serves Spark and DuckDB; the few functions spelled differently are slots.
The Spark side resolves ``{table}`` to a parquet scan, the DuckDB side to a registered view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

SCOPE = """case {key} % 3 when 0 then 'guangdong' when 1 then 'shandong' else 'inner_mongolia' end province,
 case cast(floor({key} / 3) as bigint) % 3 when 0 then 'market_rules' when 1 then 'grid_connection' else 'dispatch_ops' end doc_class,
 case {key} % 5 when 0 then 'wind' when 1 then 'solar' when 2 then 'bess' when 3 then 'coal_flex' end asset"""

CITATION = """select concat('c', cast(d.doc_id as varchar(20))) citation_id, d.doc_id,
 """ + SCOPE.replace("{key}", "d.doc_id") + """,
 concat(d.lang, ' ', d.source, ' ', cast(d.doc_id as varchar(20))) title,
 concat('https://', d.source, '.gov.cn/', d.lang, '/', cast(d.doc_id as varchar(20))) url,
 date '2015-01-01' + cast(d.doc_id % 4000 as int) effective_date, <<sha:d.text>> checksum, d.text content,
 timestamp '2024-01-01 00:00:00' + cast(d.doc_id % 720 as int) * interval '1' hour created_at"""

HEADS = [
    "'第一条 本办法自2024年3月1日起施行。风电项目并网容量不低于50MW，接入电压等级110KV，应当提交申请资料。'",
    "'发布日期：2023年5月20日。光伏发电市场交易规则规定，交易主体不得操纵价格，受理期限为15个工作日。'",
    "'（一）储能系统是指电池储能装置，安全保护要求按照标准规范执行。印发日期：2022年13月40日。'",
    "'广东省调度运行管理办法，有效期至2025-12-31。调度程序和流程由调度机构办理，煤电灵活性改造比例40%。'",
    "'山东省可再生能源消纳通知 2021/7/9，申请截止日期为2021年6月30日，检修数据报告每3个月上报。'",
    "'粤能规〔2025〕15号 市场准入资格条件与门槛，认证许可由主管部门核准，环境保护费用另行规定。'",
    "'| 项目 | 电压 | 频率 | 容量 |' || chr(10) || '| 风场 | 35KV | 50Hz | 100MW |'",
    "'General provisions for wind storage and grid connection, technical standard and safety, capacity 30 MW within 90 days.'",
]

VIEWS: dict[str, str] = {
    "citation_base": CITATION + " from {documents} d",
    "citation_vec": CITATION + ", e.embedding from {documents} d join {embeddings} e on d.doc_id = e.vec_id",
    "superseding": """select d.doc_id, m.newest from (select doc_id, <<sha:text>> h from {documents}) d
 join (select <<sha:text>> h, max(doc_id) newest from {documents} group by 1) m on d.h = m.h where d.doc_id <> m.newest""",
    "citation_v": """select c.*, case when s.newest is null then cast(null as varchar(20)) else concat('c', cast(s.newest as varchar(20))) end superseded_by
 from {citation_base} c left join {superseding} s on c.doc_id = s.doc_id""",
    "citation_emb_v": """select c.*, case when s.newest is null then cast(null as varchar(20)) else concat('c', cast(s.newest as varchar(20))) end superseded_by
 from {citation_vec} c left join {superseding} s on c.doc_id = s.doc_id""",
    "citation_zh_v": "select doc_id, citation_id, province, doc_class, asset, title, url, effective_date, checksum, "
    + "case doc_id % 8 " + " ".join(f"when {i} then {h}" for i, h in enumerate(HEADS[:-1]))
    + f" else {HEADS[-1]} end || chr(10) || chr(10) || content content from {{citation_base}}",
    "question_v": """select conv_id * 1000 + turn question_id, text question, role, conv_id,
 """ + SCOPE.replace("{key}", "conv_id") + """, case when conv_id % 4 = 0 then 'en' else 'zh' end lang,
 timestamp '2024-01-01 00:00:00' + cast(conv_id % 720 as int) * interval '1' hour asked_at
 from {conversations} where role = 'user'""",
    "question_vec": """select q.*, e.embedding from (select v.*, (select count(*) from {embeddings}) n_vec from {question_v} v) q
 join {embeddings} e on e.vec_id = q.conv_id % q.n_vec""",
    "sentence_v": """select item_id * 1000 + pos question_id, trim(s) question,
 """ + SCOPE.replace("{key}", "pos") + """ from <<sentences:{benchmark}>> where length(trim(s)) > 0""",
    "citation_zh_emb_v": """select z.*, e.embedding from {citation_zh_v} z join {embeddings} e on z.doc_id = e.vec_id""",
    "question_zh_v": """select b.item_id question_id, concat(substr(h, cast(b.item_id % 40 as int) + 1, cast(b.item_id % 5 as int) + 3), case when b.item_id % 4 = 0 then ' 2024' else '' end) question,
 """ + SCOPE.replace("{key}", "b.item_id") + """, e.embedding from (select item_id, case item_id % 6 """
    + " ".join(f"when {i} then {h}" for i, h in enumerate(HEADS[:5])) + f" else {HEADS[5]} end h from {{benchmark}}) b"
    + """ join {embeddings} e on e.vec_id = b.item_id""",
    "pack_fresh_v": """select concat('p', cast(question_id as varchar(20))) pack_id, timestamp '2024-01-30 00:00:00' - cast(question_id % 37 as int) * interval '1' hour created_at, province, doc_class, asset,
 substr(<<sha:concat_ws(':', province, doc_class, coalesce(asset, 'none'), lower(trim(question)))>>, 1, 16) query_fingerprint, case when question_id % 7 = 0 then 'expired' else 'generated' end pack_status,
 concat('stored answer ', cast(question_id as varchar(20))) answer_zh, <<array:concat('c', cast(conv_id as varchar(20))), concat('c', cast(conv_id + 1 as varchar(20)))>> citation_ids from {question_v} where conv_id % 3 = 0""",
    "result_v": """select q.question_id, q.lang, q.j + 1 "rank", 1 - q.j / 20.0 score, c.citation_id, c.doc_id, c.title, c.url, c.effective_date, c.content, c.province, c.doc_class, c.asset,
 case when c.doc_id % 17 = 0 then null else c.checksum end checksum, case when c.doc_id % 19 = 0 then 'c1' end superseded_by
 from (select *, <<explode:12>> j from {question_v}) q join {citation_zh_v} c on c.doc_id = q.conv_id * 3 + q.j""",
    "search_hit_v": """select q.question_id, q.j + 1 position, p.page_id, p.url, p.html, q.question, q.province, q.doc_class, q.asset
 from (select *, <<explode:10>> j from {question_v}) q join {pages} p on p.page_id = q.conv_id * 2 + q.j""",
    "query_log_v": """select event_id log_id, concat('t', cast(user_id as varchar(20))) trace_id, cast(user_id as varchar(20)) user_id,
 """ + SCOPE.replace("{key}", "user_id") + """,
 case event_type when 'error' then 'error' when 'signup' then 'refused' else 'ok' end verdict, event_type,
 case when event_id % 50 = 0 then null else cast(floor(value * 100) as int) end latency_ms, cast(ts as timestamp) created_at from {events}""",
    "refusal_v": """select event_id refusal_id, """ + SCOPE.replace("{key}", "user_id") + """,
 case event_id % 7 when 0 then 'stale_citation' when 1 then 'province_mismatch' when 2 then 'asset_not_supported'
  when 3 then 'unsafe_content' when 4 then 'query_too_vague' else 'no_first_party_citation' end code, cast(ts as timestamp) created_at
 from {events} where event_type = 'error'""",
    "error_v": """select event_id, case event_id % 6 when 0 then 'NO_CITATIONS found' when 1 then 'Policy check rejected'
  when 2 then 'composition error' when 3 then 'Retrieval timeout' when 4 then 'internal failure' else concat('code ', event_type) end message
 from {events} where event_type = 'error'""",
    "job_v": """select o_orderkey job_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'failed' end job_status,
 case o_orderpriority when '1-URGENT' then 'discovery' when '2-HIGH' then 'verification' when '3-MEDIUM' then 'ingestion'
  when '4-NOT SPECIFIED' then 'ocr' else 'normalization' end job_type,
 concat('src', cast(o_custkey % 40 as varchar(20)), '.gov.cn') source_domain,
 cast(o_orderkey % 5 as int) retry_count, 3 max_retries, cast(o_orderdate as timestamp) scheduled_at,
 case when o_orderstatus = 'O' then null else cast(o_orderdate as timestamp) + cast(o_orderkey % 30 as int) * interval '1' hour end completed_at,
 o_totalprice price from {orders}""",
    "job_event_v": """select event_id, user_id job_id, case event_type when 'click' then 'processing' when 'view' then 'pending'
  when 'error' then 'failed' when 'signup' then 'retrying' else 'completed' end status, cast(ts as timestamp) occurred_at from {events}""",
    "ocr_job_v": """select o_orderkey job_id, case o_orderstatus when 'F' then 'success' when 'O' then 'failed' else 'partial' end status,
 cast(floor(o_totalprice / 40) as int) processing_time_ms, cast(o_orderkey % 12 as int) pages_processed,
 cast(o_orderkey % 4 as int) tables_extracted, o_custkey % 5 <> 0 effective_date_found,
 """ + SCOPE.replace("{key}", "o_custkey") + """, cast(o_orderdate as timestamp) finished_at from {orders}""",
    "request_v": """select o_orderkey request_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'submitted' else 'processing' end status,
 case o_orderkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end priority,
 case o_orderkey % 4 when 0 then 'stale_citation' when 1 then 'unsafe_content' when 2 then 'mystery' else 'no_first_party_citation' end refusal_code,
 cast(o_orderdate as timestamp) submitted_at from {orders}""",
    "signal_v": """select o.o_orderkey signal_id, concat('signal ', o.o_orderpriority) title, concat('notice for ', c.c_name) content,
 case o.o_orderstatus when 'F' then 'policy' when 'O' then 'price' else 'tender' end signal_type, lower(substr(o.o_orderpriority, 3)) priority,
 r.r_name province, c.c_mktsegment asset_type, cast(o.o_orderdate as date) published_date,
 case when c.c_custkey % 4 = 0 then null else cast(o.o_orderdate as date) + cast(c.c_custkey % 90 as int) end deadline_date,
 least(1e0, o.o_totalprice / 499979e0) impact_score, (o.o_orderkey % 100) / 100e0 relevance_score,
 <<array:c.c_mktsegment, o.o_orderstatus>> tags
 from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey
 join {region} r on n.n_regionkey = r.r_regionkey""",
    "snapshot_v": """select page_id, url original_url, html content, <<sha:html>> checksum,
 lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) domain, timestamp '2024-01-01 00:00:00' + cast(page_id as int) * interval '1' minute fetched_at,
 case page_id % 4 when 0 then 'text/html; charset=utf-8' when 1 then 'application/pdf' when 2 then 'TEXT/HTML' else 'image/png' end content_type,
 case when page_id % 9 = 0 then 404 else 200 end http_status, length(html) content_length from {pages}""",
    "source_v": """select domain, """ + SCOPE.replace("{key}", "k") + """, concat('source ', domain) label,
 case k % 4 when 0 then <<array:'market_rules', 'dispatch_ops'>> when 1 then <<array:'grid_connection'>> else <<array:'dispatch_ops', 'grid_connection'>> end doc_classes,
 concat('R/2025-01-01T00:00:00Z/', case k % 4 when 0 then 'P1D' when 1 then 'P2DT6H' when 2 then 'PT90M' else 'P9D' end) cadence,
 case when k % 6 = 0 then 'disallow' else 'allow' end robots, case k % 3 when 0 then 'html' when 1 then 'pdf' else 'both' end fetch_method,
 case k % 4 when 0 then 'urgent' when 1 then 'high' when 2 then 'medium' else 'low' end priority, k % 5 <> 0 enabled,
 case when k % 7 = 0 then null else timestamp '2024-01-30 00:00:00' - cast(k % 100 as int) * interval '1' hour end last_crawled_at
 from (select lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) domain, min(page_id) k from {pages} group by 1) h""",
    "source_row_v": """select page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) domain, case when page_id % 6 = 0 then 'disallow' else 'allow' end robots,
 case page_id % 3 when 0 then 'html' when 1 then 'pdf' else 'both' end fetch_method from {pages}""",
    "candidate_v": """select page_id candidate_id, url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) domain,
 regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) title,
 (page_id % 100) / 100e0 confidence_score, case page_id % 3 when 0 then 'verified' when 1 then 'failed' else 'not_found' end verification_status,
 ((page_id * 7) % 100) / 100e0 verification_confidence, case when page_id % 9 = 0 then 404 else 200 end http_status,
 """ + SCOPE.replace("{key}", "page_id") + """ from {pages}""",
    "allow_v": """select distinct concat(source, '.gov.cn') domain from {documents} union
 select distinct concat(regexp_extract(url, '([a-z-]+\\.example\\.(com|org))', 1)) domain from {pages} where regexp_extract(url, '([a-z-]+\\.example\\.(com|org))', 1) <> ''""",
    "response_v": """select conv_id * 1000 + turn response_id, concat('1. Rules of ', cast(conv_id as varchar(20)), ': https://src', cast(conv_id % 30 as varchar(20)),
  '.gov.cn/doc/', cast(turn as varchar(20)), chr(10), text, chr(10), 'see https://news.example.com/', cast(turn as varchar(20)), ', and https://src', cast(conv_id % 7 as varchar(20)), '.gov.cn/a.',
  chr(10), '[{"title": "listed", "url": "https://src3.gov.cn/', cast(conv_id as varchar(20)), '"}]') content,
 """ + SCOPE.replace("{key}", "conv_id") + """ from {conversations}""",
    "pack_v": """select concat('p', cast(o_orderkey as varchar(20))) pack_id, o_custkey, cast(o_orderdate as timestamp) created_at,
 """ + SCOPE.replace("{key}", "o_custkey") + """, <<sha:cast(o_custkey as varchar(20))>> query_fingerprint,
 case o_orderstatus when 'F' then 'generated' when 'O' then 'delivered' else 'expired' end pack_status from {orders}""",
    "pack_citation_v": """select l.l_orderkey pack_id, """ + SCOPE.replace("{key}", "l.l_partkey") + """,
 cast(l.l_shipdate as date) effective_date, l.l_discount * 10 confidence_score, concat('https://s', cast(l.l_suppkey as varchar(20)), '.gov.cn/') source_url
 from {lineitem} l""",
    "metric_v": """select """ + SCOPE.replace("{key}", "doc_id").replace(""",
 case doc_id % 5 when 0 then 'wind' when 1 then 'solar' when 2 then 'bess' when 3 then 'coal_flex' end asset""", "") + """, date '2024-01-01' + cast(doc_id % 10 as int) evaluation_date,
 avg(quality) groundedness_score, avg(1 - toxic) citation_precision, case when count(*) % 3 = 0 then null else 1 - avg(toxic) end refusal_accuracy,
 count(*) total_queries from {labels} group by 1, 2, 3""",
    "mapping_v": """select citation_id, """ + "province jurisdiction, doc_class market_code, coalesce(asset, 'general') asset_type, case when doc_id % 4 = 0 then 'operation' else 'general' end lifecycle,"
    + """ case when doc_id % 3 = 0 then 'technical' else 'general' end requirement_type, case when doc_id % 6 = 0 then 'capacity' end parameter_type,
 (doc_id % 11) / 10e0 jurisdiction_confidence, (doc_id % 7) / 7e0 market_confidence, (doc_id % 5) / 5e0 asset_confidence,
 (doc_id % 3) / 3e0 lifecycle_confidence, (doc_id % 2) / 2e0 requirement_confidence, case when doc_id % 6 = 0 then 9e-1 else 0e0 end parameter_confidence
 from {citation_base} where doc_id % 13 <> 0""",
}

SPARK_SLOTS = [(r"<<sha:(.*?)>>", r"sha2(\1, 256)"), (r"<<array:(.*?)>>", r"array(\1)"),
               (r"<<explode:(\d+)>>", r"explode(sequence(0, \1 - 1))"), (r'"rank"', "rank"),
              (r"<<sentences:(.*?)>>", r"(select item_id, pos, s from \1 lateral view posexplode(split(text, '[.]')) x as pos, s)")]
DUCK_SLOTS = [(r"<<sha:(.*?)>>", r"sha256(\1)"), (r"<<array:(.*?)>>", r"[\1]"),
              (r"<<explode:(\d+)>>", r"unnest(range(0, \1))"),
              (r"<<sentences:(.*?)>>", r"(select item_id, unnest(range(0, len(l))) pos, unnest(l) s from (select item_id, string_split(text, '.') l from \1))")]
PLACE = re.compile(r"\{(\w+)\}")


def _fill(text: str, slots) -> str:
    for pattern, value in slots:
        text = re.sub(pattern, value, text)
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or one of the views above as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = _fill(VIEWS[name], SPARK_SLOTS).replace("\\", "\\\\")
    used = sorted(set(PLACE.findall(text)) & (set(TABLES) | set(VIEWS)))
    return spark.sql(text.replace("[{\"", "[{{\"").replace("\"}]", "\"}}]"), **{n: view(spark, sf_dir, n) for n in used})


def _needed(name: str, seen: list[str]) -> list[str]:
    for inner in PLACE.findall(VIEWS[name]):
        if inner in VIEWS and inner not in seen:
            _needed(inner, seen)
    if name not in seen:
        seen.append(name)
    return seen


def oracle(body: str) -> str:
    """Prepend the definitions of the views a DuckDB query mentions."""
    seen: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", body):
            _needed(name, seen)
    parts = []
    for name in seen:
        text = _fill(VIEWS[name], DUCK_SLOTS)
        text = PLACE.sub(lambda m: m.group(1) if m.group(1) in TABLES or m.group(1) in VIEWS else m.group(0), text)
        parts.append(f"{name} as ({text})")
    body = body.strip()
    if not parts:
        return body
    if body.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[5:]
    return "with " + ",\n".join(parts) + "\n" + body
