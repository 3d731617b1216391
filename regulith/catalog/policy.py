"""Guardrails, topics and answer composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from regulith.catalog.base import query
from regulith.catalog.joins import case_any, case_map
from regulith.catalog.scalar import KEY_CLAUSE
from regulith.operators.filters import enrich_results, fill_metadata
from regulith.plans import answers, policy
from regulith.sources import vocab


def _allow(v):
    return v("documents").select(F.concat("source", F.lit(".gov.cn")).alias("domain")).filter("domain not like '%5%'").distinct()


def _placeholders(v):
    return v("documents").select(F.concat("source", F.lit(".gov.cn")).alias("domain")).filter("domain like 'src3%'").distinct()


VIOLATION = """case when checksum is null then 1 when effective_date is null then 2 when regexp_extract(url, '://([^/]+)', 1) like 'src3%' then 5
 when regexp_extract(url, '://([^/]+)', 1) like '%5%' then 6 when superseded_by is not null then 7 end"""


@query("x19_guardrails", f"""select q.question_id, coalesce(n, 0) citations, case when coalesce(n, 0) = 0 then 'no_first_party_citation' else ['stale_citation', 'missing_effective_date', 'province_mismatch', 'doc_class_mismatch', 'placeholder_url_detected',
 'domain_not_allowed', 'superseded_citation'][v] end refusal_reason, case when coalesce(n, 0) = 0 or v is not null then 'refused' else 'pass' end verdict from question_v q left join (select question_id, count(*) n, min({VIOLATION}) v from result_v group by 1) r using (question_id)""")
def _(v):
    return policy.guardrails(v("result_v"), v("question_v"), _allow(v), _placeholders(v))


@query("x20_filter_by_policy", f"select question_id, citation_id from result_v where {VIOLATION} is null")
def _(v):
    return policy.filter_by_policy(v("result_v"), v("question_v"), _allow(v), _placeholders(v))[0].select("question_id", "citation_id")


@query("x20_policy_verdicts", f"""select q.question_id, coalesce(n, 0) found, coalesce(k, 0) kept, case when coalesce(n, 0) = 0 then 'no_citations' when k = 0 then 'policy_violation' else 'ok' end verdict
 from question_v q left join (select question_id, count(*) n, count(*) filter ({VIOLATION} is null) k from result_v group by 1) r using (question_id)""")
def _(v):
    return policy.filter_by_policy(v("result_v"), v("question_v"), _allow(v), _placeholders(v))[1]


@query("x21_topic_group", "select question_id, citation_id, " + case_any("lower(content)", vocab.ANSWER_TOPICS, vocab.ANSWER_REST) + " topic from result_v")
def _(v):
    return policy.topic_group(v("result_v"), vocab.ANSWER_TOPICS, vocab.ANSWER_REST, ["content"]).select("question_id", "citation_id", "topic")


PASSAGE = """case when length(content) <= 500 then content when regexp_extract(substr(content, 1, 500), '(?s)^.+[。！？]') <> '' then regexp_extract(substr(content, 1, 500), '(?s)^.+[。！？]') else substr(content, 1, 500) || '...' end"""
ORDER = "case topic " + " ".join(f"when '{n}' then {i}" for i, n in enumerate(vocab.ANSWER_TOPICS)) + f" else {len(vocab.ANSWER_TOPICS)} end"
TITLE = f"""'**' || {case_map('doc_class', vocab.DOC_CLASS_LABELS)} || '要点（' || {case_map('province', vocab.PROVINCE_LABELS)} || coalesce(' / ' || {case_map('asset', vocab.ASSET_LABELS)}, '') || '）**'"""


def compose_sql(results: str, queries: str) -> str:
    return f"""used as (select question_id, citation_id, "rank", title, effective_date, {PASSAGE} passage from {results} where "rank" <= 10 and length(trim(content)) > 0),
 topical as (select *, {case_any('lower(passage)', vocab.ANSWER_TOPICS, vocab.ANSWER_REST)} topic, '• ' || {KEY_CLAUSE.replace('{c}', 'passage')} || ' 〔《' || title || '》，生效：' || cast(effective_date as varchar) || '〕' bullet from used),
 sections as (select question_id, topic, {ORDER} o, count(*) n, '- ' || topic || '：' || chr(10) || string_agg('  ' || bullet, chr(10) order by "rank") body from topical group by 1, 2),
 bodies as (select question_id, <<i:sum(n)>> total_citations, count(*) sections, string_agg(body, chr(10) order by o) body, string_agg('**' || topic || '**: ' || n || ' requirements found', ', ' order by o) summary from sections group by 1),
 found as (select distinct question_id from {results}),
 composed as (select q.question_id, case when f.question_id is null then '抱歉，没有找到相关的一手资料。请尝试更具体的问题或联系相关部门获取最新信息。' when b.question_id is null then '抱歉，没有找到有效的引用资料。请尝试更具体的问题或联系相关部门获取最新信息。'
  else {TITLE} || chr(10) || b.body || case when q.lang = 'en' then chr(10) || chr(10) || '**English Summary:**' || chr(10) || 'This response covers ' || summary || '. Total citations: ' || total_citations || '.' else '' end end answer_zh,
  case when f.question_id is null then '没有找到相关的一手资料' when b.question_id is null then '没有找到有效的引用资料' end refusal_reason, coalesce(b.sections, 0) sections, coalesce(b.total_citations, 0) total_citations
  from {queries} q left join bodies b on q.question_id = b.question_id left join found f on q.question_id = f.question_id)"""


@query("x22_compose_answers", f"with {compose_sql('result_v', 'question_v')} select * from composed")
def _(v):
    hits = v("result_v").select("*", F.col("score").alias("vscore"), F.lit(0.0).alias("tscore"))
    out = answers.compose_answers(fill_metadata(enrich_results(hits)), v("question_v"))
    return out.select("question_id", "answer_zh", "refusal_reason", "sections", "total_citations")
