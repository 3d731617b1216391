"""Sources, sinks, filters and projections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from regulith.catalog.base import AS_OF, query
from regulith.functions.scoring import combined_confidence
from regulith.operators import filters as f
from regulith.operators import maintenance as m
from regulith.operators.joins import lookup
from regulith.session import scratch_path
from regulith.sources import tables as io

CITE = "citation_id, province, doc_class, asset, title, url, <<d:effective_date>> effective_date"
CITE_COLS = ["citation_id", "province", "doc_class", "asset", "title", "url", "effective_date"]


@query("s1_load", f"select {CITE}, checksum from citation_base")
def _(v):
    return v("citation_base").select(*CITE_COLS, "checksum")


@query("s2_lookup", "select citation_id, checksum from citation_base where checksum in (select checksum from citation_base where doc_class = 'dispatch_ops' and asset = 'wind')")
def _(v):
    keys = v("citation_base").filter("doc_class = 'dispatch_ops' and asset = 'wind'").select("checksum")
    return lookup(v("citation_base").select("citation_id", "checksum"), keys, "checksum")


@query("s3_read_layout_json", """select doc_id, url, length(content) n_chars, 1 n_pages, case when doc_id % 3 <> 0 then len(string_split(content, chr(10))) else 0 end n_blocks,
 case when doc_id % 3 <> 0 then length(content) else 0 end last_end, 1 n_tables, 9 head_end from citation_zh_v""")
def _(v):
    from regulith.catalog.texts import layout_docs

    path = scratch_path(v.spark, "layout-json")
    io.write_json(layout_docs(v).select("doc_id", "url", "text", "pages"), path)
    page = F.element_at("pages", 1)
    ends = F.flatten(F.transform(page["blocks"], lambda b: F.transform(b["layout"]["text_anchor"]["text_segments"], lambda s: s["end_index"])))
    cells = F.flatten(F.transform(F.element_at(page["tables"], 1)["header_rows"], lambda r: r["cells"]))
    return io.read_layout_json(v.spark, path, multi_line=False).select(
        "doc_id", "url", F.length("text").alias("n_chars"), F.size("pages").alias("n_pages"), F.coalesce(F.size(page["blocks"]), F.lit(0)).alias("n_blocks"),
        F.coalesce(F.array_max(ends), F.lit(0)).alias("last_end"), F.size(page["tables"]).alias("n_tables"),
        F.element_at(cells, -1)["layout"]["text_anchor"]["text_segments"][0]["end_index"].alias("head_end"))


@query("s4_write_jsonl", "select doc_id, lang, text from documents")
def _(v):
    path = scratch_path(v.spark, "docs-jsonl")
    io.write_jsonl(v("documents").select("doc_id", "lang", "text"), path)
    return v.spark.read.schema("doc_id bigint, lang string, text string").json(path)


@query("s5_write_json", "select lang, <<i:count(*)>> n, <<i:sum(length(text))>> chars from documents group by lang")
def _(v):
    path = scratch_path(v.spark, "docs-json")
    io.write_json(v("documents").select("doc_id", "lang", "text"), path, ["lang"])
    back = v.spark.read.schema("doc_id bigint, text string, lang string").json(path)
    return back.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("s6_read_binary", "select page_id % 16 part, count(*) pages, sum(octet_length(encode(html)) + 1) \"length\", sha256(string_agg(html || chr(10), '' order by page_id)) digest from pages group by 1")
def _(v):
    """Pages stored as raw files by prefix, listed and read back whole."""
    path = scratch_path(v.spark, "raw")
    pages = v("pages").select((F.col("page_id") % 16).cast("int").alias("part"), "page_id", "html")
    pages.repartition(16, "part").sortWithinPartitions("part", "page_id").select("part", "html").write.partitionBy("part").text(path)
    files = io.read_binary(v.spark, path, "*.txt").select(F.regexp_extract("path", "part=([0-9]+)/", 1).cast("int").alias("part"), "length", F.sha2("content", 256).alias("digest"))
    return files.join(pages.groupBy("part").agg(F.count("*").alias("pages")), "part")


SIGNALS = f.SignalFilter(provinces=["ASIA", "EUROPE"], min_impact_score=0.25)


@query("s9_export_signals_csv", """select cast(signal_id as varchar) "Signal ID", title "Title", '' "Title (EN)", content "Content", '' "Content (EN)",
 signal_type "Type", priority "Priority", province "Province", asset_type "Asset Type", '' "Source URL", <<d:published_date>> "Published Date",
 '' "Effective Date", coalesce(<<d:deadline_date>>, '') "Deadline Date", array_to_string(tags, ', ') "Tags", <<r:impact_score>> "Impact Score",
 <<r:relevance_score>> "Relevance Score", '' "Created At", '' "Updated At"
 from signal_v where province in ('ASIA', 'EUROPE') and impact_score >= 0.25""")
def _(v):
    out = io.signal_export_frame(v("signal_v"), SIGNALS)
    return out.withColumns({c: F.col(f"`{c}`").cast("double") for c in ("Impact Score", "Relevance Score")})


@query("s10_storage_key", r"""select page_id, concat_ws('/', replace(domain, '.', '_'), strftime(fetched_at, '%Y'), strftime(fetched_at, '%m'), substr(checksum, 1, 8),
 case when regexp_matches(name, '\.(html|pdf|xml|json|txt)$') then name else name || case when lower(content_type) like '%text/html%' then '.html'
 when lower(content_type) like '%application/pdf%' then '.pdf' else '.bin' end end) storage_key
 from (select *, regexp_replace(case when file = '' then 'document' else file end, '[^\p{L}\p{N}_\-.]', '_', 'g') name
  from (select *, regexp_extract(original_url, '([^/]*)$', 1) file from (select * replace (regexp_replace(original_url, '[?#].*$', '') as original_url) from snapshot_v)))""")
def _(v):
    return io.with_storage_key(v("snapshot_v")).select("page_id", "storage_key")


@query("s12_append_new_snapshots", """select 'stored' outcome, page_id from snapshot_v where checksum not in (select checksum from snapshot_v where http_status = 404)
 union all select 'duplicate', page_id from snapshot_v where checksum in (select checksum from snapshot_v where http_status = 404)""")
def _(v):
    snaps = v("snapshot_v").select("page_id", "checksum", "http_status")
    stored, dup = m.append_new_snapshots(snaps, snaps.filter("http_status = 404"), "checksum")
    return stored.select(F.lit("stored").alias("outcome"), "page_id").unionByName(dup.select(F.lit("duplicate").alias("outcome"), "page_id"))


@query("s13_append", "select citation_id, province from citation_base")
def _(v):
    path = scratch_path(v.spark, "citations")
    rows = v("citation_base").select("citation_id", "province")
    io.append(rows.filter("province = 'shandong'"), path, ["province"])
    io.append(rows.filter("province <> 'shandong'"), path, ["province"])
    return v.spark.read.schema(rows.schema).parquet(path)


@query("p1_scope", f"select {CITE} from citation_base where province = 'guangdong' and doc_class = 'grid_connection' and asset = 'solar'")
def _(v):
    return f.scope(v("citation_base"), "guangdong", "grid_connection", "solar").select(*CITE_COLS)


@query("p2_active", "select citation_id, province from citation_v where superseded_by is null")
def _(v):
    return f.active(v("citation_v")).select("citation_id", "province")


@query("p3_search_content", "select citation_id, <<d:effective_date>> effective_date from citation_v where superseded_by is null and contains(lower(content), 'the th')")
def _(v):
    return f.search_content(v("citation_v"), "THE th").select("citation_id", "effective_date")


@query("p4_filter_signals", """select signal_id from signal_v where province in ('ASIA', 'AFRICA') and asset_type in ('BUILDING', 'MACHINERY') and signal_type in ('policy', 'price')
 and priority in ('urgent', 'high', 'low') and published_date between date '1996-01-01' and date '1999-12-31' and impact_score >= 0.2""")
def _(v):
    flt = f.SignalFilter(["ASIA", "AFRICA"], ["BUILDING", "MACHINERY"], ["policy", "price"], ["urgent", "high", "low"],
                         dt.date(1996, 1, 1), dt.date(1999, 12, 31), None, 0.2)
    return f.filter_signals(v("signal_v"), flt).select("signal_id")


@query("p5_keyword_match", "select signal_id from signal_v where contains(lower(title), 'urg') or contains(lower(content), 'urg') or len(list_filter(tags, lambda x: contains(lower(x), 'urg'))) > 0 ")
def _(v):
    return f.keyword_match(v("signal_v"), "URG").select("signal_id")


@query("p6_recent", "select log_id from query_log_v where created_at >= timestamp '2024-01-29 00:00:00'")
def _(v):
    return f.recent(v("query_log_v"), "created_at", 24, AS_OF).select("log_id")


@query("p7_stale_sources", "select domain from source_v where enabled and (last_crawled_at is null or last_crawled_at < timestamp '2024-01-28 00:00:00')")
def _(v):
    return f.stale_sources(v("source_v"), AS_OF).select("domain")


HOURS = "case when cadence like '%P1D' then 24 when cadence like '%P2DT6H' then 54 when cadence like '%PT90M' then 1 else 216 end"


@query("p8_stale_by_cadence", f"select domain from source_v where enabled and (last_crawled_at is null or last_crawled_at < timestamp '2024-01-30 00:00:00' - {HOURS} * interval '1' hour)")
def _(v):
    return f.stale_by_cadence(v("source_v"), AS_OF).select("domain")


ALLOWED = "exists (select 1 from allow_v a where {d} = a.domain or (not starts_with(a.domain, '.') and ends_with({d}, '.' || a.domain)) or (starts_with(a.domain, '.') and ends_with({d}, a.domain)))"


@query("p9_allow_domains", "select page_id, domain from snapshot_v s where " + ALLOWED.replace("{d}", "s.domain"))
def _(v):
    return f.allow_domains(v("snapshot_v").select("page_id", "domain"), v("allow_v"))


OFFICIAL = "('.gov.cn', 'gzpec.cn', 'gdpec.com.cn', 'csg.cn', 'shandong-electric.com.cn', 'sgcc.com.cn', 'nmgdl.cn', 'scpec.com.cn')"


@query("p10_official_flag", f"""select citation_id, exists (select 1 from (select unnest({OFFICIAL.replace('(', '[').replace(')', ']')}) p) where contains(domain, p)) is_official
 from (select citation_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) domain from citation_base) c""")
def _(v):
    from regulith.functions.urls import url_host

    return f.official_flag(v("citation_base").select("citation_id", url_host("url").alias("domain"))).drop("domain")


@query("p11_official_regex", r"""select domain, regexp_matches(domain, '^(.*\.gov\.cn|gzpec\.cn|gdpec\.com\.cn|csg\.cn|shandong-electric\.com\.cn|sgcc\.com\.cn|.*\.sgcc\.com\.cn|nmgdl\.cn|scpec\.com\.cn)$') is_official
 from (select distinct concat(source, '.gov.cn') domain from documents union select distinct domain from source_v)""")
def _(v):
    hosts = v("documents").select(F.concat("source", F.lit(".gov.cn")).alias("domain")).union(v("source_v").select("domain")).distinct()
    return f.official_flag(hosts, mode="regex")


@query("p12_validate_candidates", "select candidate_id, (" + ALLOWED.replace("{d}", "s.domain") + ") and regexp_matches(url, '^https?://') and confidence_score >= 0.3 kept from candidate_v s")
def _(v):
    return f.candidate_flags(v("candidate_v"), v("allow_v")).select("candidate_id", "kept")


COUNTED = "select <<i:count(*) filter (kept)>> kept_count, <<i:count(*) filter (not kept)>> filtered_count from (select (" + ALLOWED.replace("{d}", "s.domain") + ") and confidence_score >= 0.3 kept from candidate_v s)"


@query("p12_candidate_counts", COUNTED)
def _(v):
    return f.validate_candidates(v("candidate_v"), v("allow_v"))[1]


@query("p12_store_candidates", COUNTED)
def _(v):
    """Counts of the pass that writes the valid candidates."""
    counts = f.store_candidates(v("candidate_v"), v("allow_v"), scratch_path(v.spark, "candidates"))
    return v.spark.createDataFrame([(counts["kept_count"], counts["filtered_count"])], "kept_count bigint, filtered_count bigint")


@query("p13_allowed_content_type", "select page_id from snapshot_v where trim(split_part(lower(content_type), ';', 1)) in ('text/html', 'application/pdf')")
def _(v):
    return f.allowed_content_type(v("snapshot_v")).select("page_id")


@query("p14_within_size", "select page_id, content_length from snapshot_v where content_length <= 6000")
def _(v):
    return f.within_size(v("snapshot_v"), 6000).select("page_id", "content_length")


@query("p15_high_confidence", """select candidate_id, <<r:confidence_score * 0.3 + verification_confidence * 0.7>> combined_confidence from candidate_v
 where verification_status = 'verified' and http_status = 200 and confidence_score * 0.3 + verification_confidence * 0.7 >= 0.5""")
def _(v):
    scored = v("candidate_v").withColumn("combined_confidence", combined_confidence("verification_status", F.col("confidence_score").cast("double"), F.col("verification_confidence").cast("double")))
    return f.high_confidence(scored, 0.5).select("candidate_id", "combined_confidence")


@query("p16_has_chinese", r"""select citation_id from citation_zh_v where len(regexp_extract_all(content, '[\p{L}\p{N}]')) > 0 and
 len(regexp_extract_all(content, '[\x{4e00}-\x{9fff}]')) / len(regexp_extract_all(content, '[\p{L}\p{N}]')) >= 0.1""")
def _(v):
    return f.has_chinese(v("citation_zh_v"), min_ratio=0.1).select("citation_id")


ENRICHED = """select citation_id, case when length(content) <= 500 then content when regexp_extract(substr(content, 1, 500), '(?s)^.+[。！？]') <> ''
 then regexp_extract(substr(content, 1, 500), '(?s)^.+[。！？]') else substr(content, 1, 500) || '...' end passage, title, url, <<d:effective_date>> effective_date, asset from citation_zh_v"""


@query("p17_enrich_results", ENRICHED)
def _(v):
    hits = v("citation_zh_v").select("*", F.lit(0).alias("question_id"), F.lit(0.0).alias("score"), F.lit(0.0).alias("vscore"), F.lit(0.0).alias("tscore"), F.lit(1).alias("rank"))
    return f.enrich_results(hits).select("citation_id", "passage", "metadata.title", "metadata.url", "metadata.effective_date", "metadata.asset")


@query("p18_fill_metadata", "select citation_id, case when asset is null then '未知文档' else title end title, case when asset = 'wind' then '未知' else <<d:effective_date>> end effective_date, url, true validation_passed from citation_base")
def _(v):
    base = v("citation_base").select("citation_id", F.struct(
        F.when(F.col("asset").isNotNull(), F.col("title")).alias("title"), "url",
        F.when(~F.col("asset").eqNullSafe("wind"), F.date_format("effective_date", "yyyy-MM-dd")).alias("effective_date")).alias("metadata"))
    return f.fill_metadata(base).select("citation_id", "metadata.title", "metadata.effective_date", "metadata.url", "validation_passed")


@query("p19_complete_citations", "select citation_id from citation_base where asset is not null and asset <> 'wind' and length(trim(content)) > 0")
def _(v):
    base = v("citation_base").select("citation_id", F.col("content").alias("passage"), F.struct(
        F.when(F.col("asset").isNotNull(), F.col("title")).alias("title"),
        F.when(~F.col("asset").eqNullSafe("wind"), F.col("effective_date")).alias("effective_date")).alias("metadata"))
    return f.complete_citations(base).select("citation_id")
