"""Scalar functions, each over a whole column."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from regulith.catalog.base import query
from regulith.functions import checks, dates, layout, scoring, text, urls, vectors
from regulith.plans import policy
from regulith.sources import vocab

ASOF = dt.date(2026, 1, 1)
CJK = r"[\x{4e00}-\x{9fff}]"
AN = r"[\p{L}\p{N}]"


def n_of(c: str, p: str) -> str:
    return f"len(regexp_extract_all({c}, '{p}'))"


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def squeeze_sql(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


@query("f1_hashes", "select doc_id, sha256(text) sha, md5(text) md from documents")
def _(v):
    return v("documents").select("doc_id", text.sha256_hex("text").alias("sha"), text.md5_hex("text").alias("md"))


@query("f2_stable_id", r"select citation_id, regexp_replace(substr(sha256(url || ':' || checksum), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') id from citation_base")
def _(v):
    return v("citation_base").select("citation_id", text.stable_id("url", "checksum").alias("id"))


@query("f3_fingerprints", f"""select question_id, sha256(concat_ws(':', province, asset, doc_class, lower({strip_sql('question')}))) raw,
 sha256(concat_ws(':', province, asset, doc_class, regexp_replace(regexp_replace(lower({strip_sql('question')}), '\\s+', ' ', 'g'), '[？?！!。.，,；;：:]', '', 'g'))) clean,
 substr(sha256(concat_ws(':', province, doc_class, coalesce(asset, 'none'), lower({strip_sql('question')}))), 1, 16) short from question_v""")
def _(v):
    args = ("province", "asset", "doc_class", "question")
    return v("question_v").select("question_id", *[text.fingerprint(*args, variant=x).alias(x) for x in ("raw", "clean", "short")])


@query("f4_squeeze_ws", f"select doc_id, {squeeze_sql('text')} t from documents")
def _(v):
    return v("documents").select("doc_id", text.squeeze_ws("text").alias("t"))


@query("f5_truncate", "select doc_id, case when length(text) <= 8192 then text else substr(text, 1, 8192) end cut, case when length(text) <= 100 then text else substr(text, 1, 97) || '...' end short from documents")
def _(v):
    return v("documents").select("doc_id", text.truncate("text", 8192).alias("cut"), text.truncate("text", 100, "...").alias("short"))


@query("f6_passage", "select doc_id, case when length(content) <= 500 then content when regexp_extract(substr(content, 1, 500), '(?s)^.+[。！？]') <> '' then regexp_extract(substr(content, 1, 500), '(?s)^.+[。！？]') else substr(content, 1, 500) || '...' end p from citation_zh_v")
def _(v):
    return v("citation_zh_v").select("doc_id", text.passage("content").alias("p"))


KEY_CLAUSE = f"""case when length({strip_sql('{c}')}) <= 100 then {strip_sql('{c}')} when length(regexp_split_to_array({strip_sql('{c}')}, '[。！？]')[1]) <= 150
 then regexp_split_to_array({strip_sql('{c}')}, '[。！？]')[1] || '。' when length({strip_sql('{c}')}) > 150 then substr({strip_sql('{c}')}, 1, 147) || '...' else {strip_sql('{c}')} end"""


@query("f7_key_clause", "select doc_id, " + KEY_CLAUSE.replace("{c}", "content") + " k from citation_zh_v")
def _(v):
    return v("citation_zh_v").select("doc_id", text.key_clause("content").alias("k"))


@query("f8_quote_first", rf"select doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(content, '[。\n]'), lambda x: {strip_sql('x')}), lambda x: length(x) > 0)[1:2], '；') q from citation_zh_v")
def _(v):
    return v("citation_zh_v").select("doc_id", text.quote_first("content").alias("q"))


UNESCAPE = "replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query("f9_strip_html", f"select page_id, trim(regexp_replace({UNESCAPE}, '\\s+', ' ', 'g')) t from pages")
def _(v):
    return v("pages").select("page_id", urls.strip_html("html").alias("t"))


NO_SCRIPT = r"regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"


@query("f10_strip_script_html", f"select page_id, {NO_SCRIPT} t from pages")
def _(v):
    return v("pages").select("page_id", urls.strip_script_html("html").alias("t"))


TITLE = rf"nullif(substr({squeeze_sql(chr(39).join(['regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)']))}, 1, 200), '')"


@query("f11_html_title_lang", f"""select page_id, {TITLE} title, nullif(regexp_extract(html, '(?i)<html[^>]*lang=["'']([^"'']+)["'']', 1), '') lang from pages""")
def _(v):
    return v("pages").select("page_id", urls.html_title("html").alias("title"), urls.html_lang("html").alias("lang"))


@query("f12_first_line_title", f"select doc_id, substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: length(x) > 10)[1], 1, 200) title from documents")
def _(v):
    return v("documents").select("doc_id", text.first_line_title("text").alias("title"))


HOST = r"lower(regexp_extract(url, '^(?:https?://)?([^/?:#]*)', 1))"


@query("f13_url_host", f"select page_id, {HOST} host, regexp_replace({HOST}, '^(www\\.)?(m\\.)?(wap\\.)?', '') bare from pages")
def _(v):
    return v("pages").select("page_id", urls.url_host("url").alias("host"), urls.url_host("url", True).alias("bare"))


TRACK = "['utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','msclkid','ref','source','from','spm']"
CANON = rf"""(select page_id, 'https://' || host || case when path = '/' then path else regexp_replace(path, '/+$', '') end || case when kept = '' then '' else '?' || kept end canonical
 from (select page_id, regexp_extract(url, '://([^/?#]*)', 1) host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) path,
 array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: length(p) > 0 and not list_contains({TRACK}, lower(split_part(p, '=', 1)))), '&') kept from pages))"""


@query("f14_canonical_url", f"select page_id, canonical from {CANON}")
def _(v):
    return v("pages").select("page_id", urls.canonical_url("url").alias("canonical"))


def tokens_sql(c: str) -> str:
    return (f"(case when length({c}) = 0 then 0 else greatest(1, cast(floor({n_of(c, CJK)} * 1.5::double + {n_of(f'regexp_replace({c}, {chr(39)}{CJK}{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')} * 1.3::double"
            f" + (length({c}) - length(replace({c}, ' ', ''))) * 0.5::double) as bigint)) end)")


@query("f15_token_estimate", f"select doc_id, {tokens_sql('content')} words, cast(floor({n_of('content', CJK)} * 1.5::double + (length(content) - {n_of('content', CJK)}) * 0.5::double) as bigint) chars from citation_zh_v")
def _(v):
    return v("citation_zh_v").select("doc_id", text.token_estimate("content").alias("words"), text.token_estimate("content", "chars").alias("chars"))


RATIO = f"({n_of('content', CJK)} / nullif({n_of('content', AN)}, 0))"


@query("f16_language_label", f"select doc_id, case when {RATIO} is null then null when {RATIO} >= 0.3 then 'zh-CN' when {RATIO} >= 0.1 then 'zh-mixed' else 'other' end label from citation_zh_v")
def _(v):
    return v("citation_zh_v").select("doc_id", text.language_label("content").alias("label"))


FULL = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
HALF = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")


UNITS = "千瓦|兆瓦|万千瓦|千伏|万伏|千米|公里|米|厘米|毫米|吨|千克|公斤|克|升|毫升|小时|分钟|秒|年|月|日|天"


@query("f18_clean_ocr", rf"""select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(t, '|｜□■▪▫', ''), '(\d+)\s*({UNITS})', '\1\2', 'g'), '(\d)O(\d)', '\1' || '0\2', 'g'), '(\d)l(\d)', '\1' || '1\2', 'g'), '(\d)S(\d)', '\1' || '5\2', 'g') t
 from (select doc_id, '3O7 | 50 兆瓦 1l2S4 ' || content t from citation_zh_v)""")
def _(v):
    return v("citation_zh_v").select("doc_id", text.clean_ocr(F.concat(F.lit("3O7 | 50 兆瓦 1l2S4 "), F.col("content"))).alias("t"))


@query("f20_relevance", """select a.candidate_id, <<r:least(case when b.url = a.url then 0.5 when contains(b.url, a.url) or contains(a.url, b.url) then 0.3 when a.domain = b.domain then 0.2 else 0 end
 + 0.3 * coalesce(sim, 0) + least(0.02 * ((contains(b.content, '并网'))::int + contains(b.content, '调度')::int + contains(b.content, '市场')::int + contains(b.content, '交易')::int + contains(b.content, '能源')::int
 + contains(b.content, '电力')::int + contains(b.content, '光伏')::int + contains(b.content, '风电')::int + contains(b.content, '储能')::int), 0.2), 1.0)>> score from (
 select c.candidate_id, c.url, c.domain, c.title, k.url url2, k.title title2, k.content, """ + """(select case when len(u) = 0 then 0 else len(list_intersect(x, y)) / len(u) end from (select x, y, list_distinct(list_concat(x, y)) u from (select
 list_distinct(list_filter(regexp_split_to_array(lower(c.title), '\\s+'), lambda w: length(w) > 0)) x, list_distinct(list_filter(regexp_split_to_array(lower(k.title), '\\s+'), lambda w: length(w) > 0)) y))) sim
 from candidate_v c join citation_zh_v k on c.candidate_id = k.doc_id) a, lateral (select a.url2 url, a.content, lower(regexp_extract(a.url2, '^https?://([^/?#:]+)', 1)) "domain") b""")
def _(v):
    c, k = v("candidate_v"), v("citation_zh_v")
    hits = k.select(F.col("doc_id").alias("candidate_id"), F.col("url").alias("link"), F.col("title").alias("hit_title"), F.col("content").alias("snippet"))
    return c.join(hits, "candidate_id").select("candidate_id", scoring.relevance("link", "hit_title", "snippet", "url", "title").alias("score"))


@query("f21_combined_confidence", "select candidate_id, <<r:case when verification_status = 'verified' then confidence_score * 0.3 + verification_confidence * 0.7 else 0 end>> c from candidate_v")
def _(v):
    return v("candidate_v").select("candidate_id", scoring.combined_confidence("verification_status", F.col("confidence_score").cast("double"), F.col("verification_confidence").cast("double")).alias("c"))


def hits_sql(c: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({c}, '{w}')::int" for w in words) + ")"


@query("f22_discovery_confidence", f"""select citation_id, <<r:least(1.0, 0.5 + 0.2 + case when contains(domain, '.gov.cn') or contains(domain, 'gzpec.cn') then 0.2 else 0 end + least({hits_sql('t', scoring.DISCOVERY_TERMS)} * 0.05, 0.2)
 + case when province = 'guangdong' and regexp_matches(t, '广东|粤') or province = 'shandong' and regexp_matches(t, '山东|鲁') or province = 'inner_mongolia' and regexp_matches(t, '内蒙古|蒙') then 0.1 else 0 end)>> c
 from (select *, lower(content || ' ' || url) t, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) domain from citation_zh_v)""")
def _(v):
    return v("citation_zh_v").select("citation_id", scoring.discovery_confidence("content", "url", urls.url_host("url"), "province", [".gov.cn", "gzpec.cn"]).alias("c"))


def count_sql(c: str, k: str) -> str:
    return f"coalesce(floor((length({c}) - length(replace({c}, {k}, ''))) / nullif(length({k}), 0)), 0)"


ONLINE = "(2.0 * (" + " + ".join(count_sql("{t}", k) for k in ("lower({q})", "lower({c})", "lower({p})", "lower(coalesce({a}, ''))")) + ") + 0.5 * len(regexp_extract_all({t}, '" + "|".join(scoring.CUE_WORDS) + "')))"


def online_sql(t: str, q: str, c: str, p: str, a: str) -> str:
    return ONLINE.replace("{t}", t).replace("{q}", q).replace("{c}", c).replace("{p}", p).replace("{a}", a)


@query("f23_online_score", f"select citation_id, <<r:{online_sql('lower(content)', chr(39) + 'the' + chr(39), 'doc_class', 'province', 'asset')}>> s from citation_zh_v")
def _(v):
    return v("citation_zh_v").select("citation_id", scoring.online_score("content", F.lit("the"), "doc_class", "province", "asset").alias("s"))


@query("f24_cadence", """select domain, <<i:h>> n_hours, <<t:last_crawled_at + h * interval '1' hour>> next_crawl from (select *, case when cadence like '%P1D' then 24 when cadence like '%P2DT6H' then 54
 when cadence like '%PT90M' then 1 else 216 end h from source_v)""")
def _(v):
    return v("source_v").select("domain", dates.cadence_hours("cadence").alias("n_hours"), dates.next_crawl("last_crawled_at", "cadence").alias("next_crawl"))


def ymd_sql(c: str, p: str) -> str:
    g = [f"regexp_extract({c}, '{p}', {i})" for i in (1, 2, 3)]
    return f"try_cast(lpad({g[0]}, 4, '0') || '-' || lpad({g[1]}, 2, '0') || '-' || lpad({g[2]}, 2, '0') as date)"


ZH, ISO, SLASH, DOT = r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{4})/(\d{1,2})/(\d{1,2})", r"(\d{4})\.(\d{1,2})\.(\d{1,2})"


@query("f25_parse_zh_date", f"select citation_id, <<d:coalesce({ymd_sql('content', ZH)}, {ymd_sql('content', ISO)}, {ymd_sql('content', SLASH)})>> d from citation_zh_v")
def _(v):
    return v("citation_zh_v").select("citation_id", dates.parse_zh_date("content").alias("d"))


SIMPLE_PATTERNS = [ZH, ISO, SLASH, DOT, "自" + ZH + "起", "发布日期[：:]" + ISO, "生效日期[：:]" + ISO]
SIMPLE_SQL = "coalesce(" + ", ".join(f"case when {ymd_sql('{t}', p)} <= date '2026-01-01' then {ymd_sql('{t}', p)} end" for p in SIMPLE_PATTERNS) + ")"
DATED_URL = "url || case doc_id % 6 when 0 then '/2024/3/1/' when 1 then '/20230715/x' when 2 then '_20221301_' when 3 then '-20210630-' when 4 then '?d=2020-2-9' else '/1999-01-01' end"
RANGE = "between date '2000-01-01' and date '2036-12-31'"


def url_date_sql(c: str) -> str:
    ps = [r"/(\d{4})/(\d{1,2})/(\d{1,2})/", r"/(\d{4})(\d{2})(\d{2})/", r"_(\d{4})(\d{2})(\d{2})_", r"-(\d{4})(\d{2})(\d{2})-", ISO]
    return "coalesce(" + ", ".join(f"case when {ymd_sql(c, p)} {RANGE} then {ymd_sql(c, p)} end" for p in ps) + ")"


@query("f27_date_from_url", f"select citation_id, <<d:{url_date_sql('u')}>> d from (select citation_id, {DATED_URL} u from citation_base)")
def _(v):
    return v("citation_base").select("citation_id", F.expr(DATED_URL).alias("u")).select("citation_id", dates.date_from_url("u", ASOF).alias("d"))


@query("f28_potential_date", r"select citation_id, coalesce(nullif(regexp_extract(t, '\d{4}-\d{1,2}-\d{1,2}'), ''), nullif(regexp_extract(t, '\d{4}年\d{1,2}月\d{1,2}日'), ''), nullif(regexp_extract(t, '\d{4}/\d{1,2}/\d{1,2}'), '')) d from (select citation_id, url || ' ' || content t from citation_zh_v)")
def _(v):
    return v("citation_zh_v").select("citation_id", dates.potential_date("url", "content").alias("d"))


@query("f29_mask_middle", "select c_custkey, case when length(c_name) <= 8 then repeat('*', length(c_name)) else left(c_name, 4) || repeat('*', length(c_name) - 8) || right(c_name, 4) end masked from customer")
def _(v):
    return v("customer").select("c_custkey", text.mask_middle("c_name").alias("masked"))


@query("f32_normalize", "select vec_id, <<r:sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))>> norm, <<r:(embedding[1]::double) / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))>> first_unit from embeddings")
def _(v):
    return v("embeddings").select("vec_id", vectors.l2_norm("embedding").alias("norm"), vectors.l2_normalize("embedding")[0].alias("first_unit"))


@query("f33_cosine", "select q.question_id, c.citation_id, <<r:list_cosine_similarity(q.embedding::double[], c.embedding::double[])>> s from question_vec q join citation_vec c on c.doc_id = q.conv_id")
def _(v):
    c = v("citation_vec").select("citation_id", F.col("doc_id").alias("conv_id"), F.col("embedding").alias("e"))
    return v("question_vec").join(c, "conv_id").select("question_id", "citation_id", vectors.cosine("embedding", "e").alias("s"))


@query("f34_blend", "select candidate_id, <<r:0.6 * confidence_score + 0.4 * verification_confidence>> s from candidate_v")
def _(v):
    return v("candidate_v").select("candidate_id", vectors.blend(F.col("confidence_score").cast("double"), F.col("verification_confidence").cast("double")).alias("s"))


def all_sql(p: str) -> str:
    return f"array_to_string(regexp_extract_all(content, '{p}', 1), ',')"


@query("f35_parameter_values", f"""select citation_id, nullif({all_sql(r'(?i)(\d+(?:\.\d+)?)\s*(?:MW|兆瓦|千瓦|KW)')}, '') capacity, nullif({all_sql(r'(?i)(\d+(?:\.\d+)?)\s*(?:KV|千伏|伏)')}, '') voltage,
 nullif({all_sql(r'(\d+(?:\.\d+)?)\s*%')}, '') percentage, nullif({all_sql(r'(?i)(\d+)\s*(?:天|日|月|年|days?|months?|years?)')}, '') timeline from citation_zh_v""")
def _(v):
    found = v("citation_zh_v").select("citation_id", text.parameter_values("content").alias("m"))
    return found.select("citation_id", *[F.array_join(F.try_element_at("m", F.lit(k)), ",").alias(k) for k in ("capacity", "voltage", "percentage", "timeline")])


@query("f36_bare_urls", r"""select response_id, array_to_string(list_transform(regexp_extract_all(content, 'https?://[^\s)]+'), lambda u: regexp_replace(u, '[.,);\]''"]+$', '')), ' ') links from response_v""")
def _(v):
    return v("response_v").select("response_id", F.array_join(urls.bare_urls("content"), " ").alias("links"))


@query("f37_json_links", r"""select response_id, 'listed' title, regexp_extract(content, '"url": "([^"]+)"', 1) url from response_v""")
def _(v):
    return v("response_v").select("response_id", F.explode(urls.json_links("content")).alias("l")).select("response_id", "l.title", "l.url")


@query("f38_snippet_around", """select response_id, case when length(s) > 300 then substr(s, 1, 300) || '...' else s end snippet from (select response_id, trim(regexp_replace(substr(content, greatest(1, p - 200), least(length(content), p - 1 + 24 + 200) - greatest(1, p - 200) + 1), '\\s+', ' ', 'g')) s
 from (select *, strpos(content, 'https://news.example.com') p from response_v))""")
def _(v):
    return v("response_v").select("response_id", text.snippet_around("content", F.lit("https://news.example.com")).alias("snippet"))


@query("f41_mime_and_format", """select page_id, case when lower(url) like '%.pdf' then 'application/pdf' when lower(url) like '%.html' or lower(url) like '%.htm' then 'text/html' else 'application/pdf' end mime,
 case when lower(content_type) like '%text/html%' then 'html' when lower(content_type) like '%application/pdf%' then 'pdf' else 'unknown' end fmt from (select page_id, original_url url, content_type from snapshot_v)""")
def _(v):
    return v("snapshot_v").select("page_id", urls.mime_from_path("original_url").alias("mime"), urls.doc_format("content_type").alias("fmt"))


@query("f42_join_segments", "select doc_id, case when length(text) > 20 then substr(text, 6, 5) || substr(text, 11, 10) when length(text) >= 20 then substr(text, 6, 5) || substr(text, 11, 10) when length(text) >= 10 then substr(text, 6, 5) else '' end t from documents")
def _(v):
    segs = F.array(*[F.struct(F.lit(a).alias("start_index"), F.lit(b).alias("end_index")) for a, b in ((5, 10), (10, 20), (9, 3))])
    return v("documents").select("doc_id", layout.join_segments(F.col("text"), segs).alias("t"))


@query("f43_table_markdown", "select citation_id, '| a | ' || province || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_class || ' |  |' md, <<i:2>> row_count, <<i:2>> col_count from citation_base")
def _(v):
    header = F.array(F.array(F.lit("a"), F.col("province")))
    body = F.array(F.array(F.col("doc_class")))
    return v("citation_base").select("citation_id", layout.table_markdown(header, body).alias("t")).select("citation_id", F.col("t.markdown").alias("md"), "t.row_count", "t.col_count")


def refusal_case(i: int) -> str:
    return "case code " + " ".join(f"when '{r[0]}' then '{r[i].replace(chr(39), chr(39) * 2)}'" for r in vocab.REFUSALS) + " end"


LONG = "case province when 'guangdong' then '广东省' when 'shandong' then '山东省' else '内蒙古自治区' end"
SHORT = "case asset when 'wind' then '风电' when 'solar' then '光伏' when 'bess' then '储能' when 'coal_flex' then '煤电' end"


@query("f44_refusal_template", f"""select refusal_id, case when code = 'asset_not_supported' and asset is not null then '抱歉，' || {LONG} || '暂无' || {SHORT} || '相关的政策资料。' else {refusal_case(1)} end message_zh, {refusal_case(2)} message_en,
 {refusal_case(3)} || case when code = 'no_first_party_citation' then ' 您也可以直接访问' || {LONG} || '电力交易中心官网获取最新信息。' else '' end suggestion_zh, {refusal_case(4)} suggestion_en from refusal_v""")
def _(v):
    return policy.with_refusal_template(v("refusal_v")).select("refusal_id", "message_zh", "message_en", "suggestion_zh", "suggestion_en")


@query("f46_eligibility", """select request_id, refusal_code <> 'unsafe_content' eligible, case refusal_code when 'stale_citation' then 'high' when 'no_first_party_citation' then 'medium' when 'mystery' then 'low' end suggested_priority,
 <<i:case refusal_code when 'stale_citation' then 2 when 'no_first_party_citation' then 3 when 'mystery' then 5 end>> processing_days,
 case refusal_code when 'stale_citation' then '1-2 business days' when 'no_first_party_citation' then '2-3 business days' when 'mystery' then '3-5 business days' end processing_time,
 case when refusal_code = 'unsafe_content' then 'Please rephrase your query' end alternative from request_v""")
def _(v):
    return policy.with_eligibility(v("request_v"), "refusal_code").select("request_id", "eligible", "suggested_priority", "processing_days", "processing_time", "alternative")


@query("f47_strip_punct", r"""select citation_id, regexp_replace(content, '[，。！？；：“”‘’（）【】《》、.,!?;:"''()\[\]<>]', '', 'g') t from citation_zh_v""")
def _(v):
    return v("citation_zh_v").select("citation_id", text.strip_punct("content").alias("t"))


OVERALL = "case when parameter_confidence > 0 then (jurisdiction_confidence + market_confidence + asset_confidence + lifecycle_confidence + requirement_confidence + parameter_confidence) / 6 else (jurisdiction_confidence + market_confidence + asset_confidence + lifecycle_confidence + requirement_confidence) / 5 end"
CONF = [f"{x}_confidence" for x in ("jurisdiction", "market", "asset", "lifecycle", "requirement", "parameter")]


@query("f48_ontology_path", "select citation_id, concat_ws(' → ', jurisdiction, market_code, asset_type, lifecycle, requirement_type, parameter_type) path from mapping_v")
def _(v):
    return v("mapping_v").select("citation_id", scoring.ontology_path("jurisdiction", "market_code", "asset_type", "lifecycle", "requirement_type", "parameter_type").alias("path"))


@query("f49_overall_confidence", f"select citation_id, <<r:{OVERALL}>> c from mapping_v")
def _(v):
    return v("mapping_v").select("citation_id", scoring.overall_confidence(*[F.col(c).cast("double") for c in CONF]).alias("c"))


@query("f50_edit_similarity", "select p_partkey, <<r:1.0 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))>> s from part")
def _(v):
    return v("part").select("p_partkey", scoring.edit_similarity("p_name", "p_type").alias("s"))


@query("f51_format_checks", r"""select citation_id, regexp_matches(lower(checksum), '^[0-9a-f]{64}$') sha, regexp_matches(substr(checksum, 1, 32), '^[0-9a-f]{32}$') trace, true dom,
 true url_ok, doc_id % 2 = 0 cadence from citation_base""")
def _(v):
    cadence = F.when(F.col("doc_id") % 2 == 0, "R/2025-01-01T00:00:00Z/P1DT2H").otherwise("every day")
    return v("citation_base").select("citation_id", checks.is_sha256("checksum").alias("sha"), checks.is_trace_id(F.substring("checksum", 1, 32)).alias("trace"),
                                     checks.is_domain(urls.url_host("url")).alias("dom"), checks.is_url("url").alias("url_ok"), checks.is_cadence(cadence).alias("cadence"))


@query("f52_robots_allowed", "select domain, robots <> 'disallow' allowed from source_v")
def _(v):
    body = F.when(F.col("robots") == "disallow", F.lit("User-agent: *\nDisallow: /")).otherwise(F.lit("User-agent: *\nAllow: /"))
    return v("source_v").select("domain", urls.robots_allowed(body).alias("allowed"))
