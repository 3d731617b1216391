"""Chunking, layout and effective dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from regulith.catalog import fold_sql as q
from regulith.catalog.base import query
from regulith.catalog.scalar import SIMPLE_SQL, ZH, strip_sql, tokens_sql, ymd_sql
from regulith.functions.layout import merge_short, page_tables
from regulith.functions.text import normalize_cjk, token_estimate
from regulith.operators.aggregates import chunk_quality
from regulith.plans import chunking as c
from regulith.plans import effective_dates as e
from regulith.sources import vocab

ASOF = dt.date(2026, 1, 1)
ZH_TEXT = "(select doc_id, url, content text from citation_zh_v)"
LAYOUT_PARAS = q.paragraphs(ZH_TEXT, "doc_id % 3 <> 0")


CHUNK_ID = r"regexp_replace(substr(sha256(concat(doc_id, ':', pos)), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')"


def chunk_rows(paras: str, max_tokens: int, overlap: int, min_clause: int) -> str:
    """Chunks with id, place and type, as of ``chunk_document``."""
    return f"""with paras as (select * from {paras}), {q.chunks('paras', max_tokens, overlap, min_clause)}
 select doc_id, pos, {CHUNK_ID} chunk_id, content, start_char, start_char + length(content) end_char, <<i:token_count>> token_count, {CLAUSE} clause_type from chunk"""


CLAUSE = "case " + " ".join(f"when regexp_matches(content, '{p}') then '{n}'" for n, p in vocab.CLAUSE_TYPES) + " else 'general' end"


def layout_docs(v):
    """Layout documents made from the texts: a block per line (two thirds of them) and one table."""
    ends = F.aggregate(
        F.split("text", "\n"), F.array(F.lit(0)), lambda a, line: F.concat(a, F.array(F.element_at(a, -1) + F.length(line) + 1)))
    seg = lambda s, t: F.struct(s.cast("int").alias("start_index"), t.cast("int").alias("end_index"))
    anchor = lambda s, t: F.struct(F.array(seg(s, t)).alias("text_segments"))
    blocks = F.transform(F.slice("_e", 1, F.size("_e") - 1), lambda s, i: F.struct(F.struct(
        (F.lit(0.5) + (i % 5) / 10.0).cast("double").alias("confidence"), anchor(s, F.get("_e", i + 1) - 1).alias("text_anchor")).alias("layout")))
    cell = lambda s, t: F.struct(F.struct(anchor(F.lit(s), F.lit(t)).alias("text_anchor")).alias("layout"))
    row = lambda *cells: F.struct(F.array(*cells).alias("cells"))
    table = F.struct(F.array(row(cell(0, 4), cell(4, 9))).alias("header_rows"), F.array(row(cell(9, 15))).alias("body_rows"))
    docs = v.dealt("citation_zh_v").select("doc_id", "url", "province", "doc_class", "title", F.col("content").alias("text")).withColumn("_e", ends)
    page = F.struct(F.when(F.col("doc_id") % 3 != 0, blocks).alias("blocks"), F.array(table).alias("tables"))
    return docs.withColumn("pages", F.array(page)).drop("_e")


@query("x4_chunk_document", chunk_rows(LAYOUT_PARAS, 800, 100, 50))
def _(v):
    return c.chunk_document(c.with_paragraphs(layout_docs(v)))


@query("x4_chunk_small", chunk_rows(q.paragraphs(ZH_TEXT), 100, 20, 10))
def _(v):
    return c.chunk_document(c.with_paragraphs(v("citation_zh_v").withColumn("text", F.col("content"))), max_tokens=100, overlap=20, min_clause=10)


@query("x4b_chunk_text", f"""with {q.text_chunks('documents', 200, 100)} select doc_id, pos, 'chunk_' || lpad(cast(pos + 1 as varchar), cast(greatest(3, length(cast(pos + 1 as varchar))) as int), '0') chunk_id, {strip_sql('text')} content, tokens token_count,
 <<i:before>> start_pos, <<i:before + length(text)>> end_pos from piece""")
def _(v):
    return c.chunk_text(v.dealt("documents"), 200)


SPLIT = f"(select doc_id, pos + 1 ordinal, title || ' - 第' || (pos + 1) || '部分' title, {strip_sql('part')} content from (select doc_id, title, unnest(string_split(content, chr(10) || chr(10))) part, unnest(range(0, len(string_split(content, chr(10) || chr(10))))) pos from citation_zh_v) where length({strip_sql('part')}) > 0)"


@query("x4c_split_chunks", f"select doc_id, ordinal, title, content from {SPLIT}")
def _(v):
    return c.split_chunks(v("citation_zh_v"))


@query("a12_chunk_quality", f"""select count(*) total_chunks, <<r:avg(t)>> avg_tokens, <<i:min(t)>> min_tokens, <<i:max(t)>> max_tokens, count(*) filter (t < 50) chunks_under_min, count(*) filter (t > 800) chunks_over_max,
 <<i:sum(length(content))>> total_content_length from (select content, {tokens_sql('content')} t from {SPLIT})""")
def _(v):
    return chunk_quality(c.split_chunks(v("citation_zh_v")).withColumn("token_count", token_estimate("content")))


@query("x5_clause_type", f"select doc_id, ordinal, {CLAUSE} clause_type from {SPLIT}")
def _(v):
    return c.split_chunks(v("citation_zh_v")).select("doc_id", "ordinal", c.clause_type("content").alias("clause_type"))


@query("a12_clause_histogram", f"select {CLAUSE} clause_type, count(*) \"count\" from {SPLIT} group by 1")
def _(v):
    return c.split_chunks(v("citation_zh_v")).groupBy(c.clause_type("content").alias("clause_type")).agg(F.count("*").alias("count"))


SPACED = "第 一 条  2024 年 3 月（Ａ）！ "


@query("f17_normalize_cjk", f"select doc_id, {q.normalized(q.quoted(SPACED) + ' || content')} t from citation_zh_v")
def _(v):
    return v("citation_zh_v").select("doc_id", normalize_cjk(F.concat(F.lit(SPACED), F.col("content"))).alias("t"))


@query("x6_merge_short", f"select doc_id, array_to_string({q.merged_short('string_split(text, chr(10))')}, chr(10) || '--' || chr(10)) merged from documents")
def _(v):
    return v("documents").select("doc_id", F.array_join(merge_short(F.split("text", "\n")), "\n--\n").alias("merged"))


@query("x7_paragraphs", f"select doc_id, len(paragraphs) n, array_to_string(paragraphs, chr(10)) \"text\" from {LAYOUT_PARAS}")
def _(v):
    return c.with_paragraphs(layout_docs(v)).select("doc_id", F.size("paragraphs").alias("n"), F.array_join("paragraphs", "\n").alias("text"))


CELLS = [q.normalized(f"substr(text, {a} + 1, {b} - {a})") for a, b in ((0, 4), (4, 9), (9, 15))]


@query("f43_layout_tables", f"select doc_id, '| ' || {CELLS[0]} || ' | ' || {CELLS[1]} || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || {CELLS[2]} || ' |  |' markdown, 2 row_count, 2 col_count, 0.9e0 confidence from {ZH_TEXT}")
def _(v):
    rows = layout_docs(v).select("doc_id", F.explode(page_tables(F.col("pages"), F.col("text"))).alias("t"))
    return rows.select("doc_id", "t.markdown", "t.row_count", "t.col_count", "t.confidence")


@query("a28_layout_metadata", f"""select doc_id, 1 page_count, length(text) text_length, 1 table_count, true has_tables, len(paragraphs) paragraph_count,
 <<r:case when doc_id % 3 = 0 then 0 else list_avg([0.5e0 + (i % 5) / 10e0 for i in range(0, len(string_split(text, chr(10))))]) end>> avg_confidence, {q.language('text')} "language" from {LAYOUT_PARAS}""")
def _(v):
    return c.layout_metadata(layout_docs(v))


def _dated(v):
    return v.dealt("citation_zh_v").select("doc_id", F.col("content").alias("text"), "url")


@query("x8_effective_date", f"with {q.dates(ZH_TEXT)} select doc_id, <<d:dd>> effective_date from dd")
def _(v):
    return e.effective_date(_dated(v), ASOF).select("doc_id", "effective_date")


@query("x8b_effective_date_simple", f"select doc_id, <<d:{SIMPLE_SQL.replace('{t}', 't')}>> effective_date from (select doc_id, content || ' ' || url t from citation_zh_v)")
def _(v):
    return e.effective_date_simple(_dated(v), ASOF).select("doc_id", "effective_date")


PUB = [r"(?:发布|公布|颁布|印发|批准|核准|审批)(?:日期|时间)?[：:]" + ZH.replace(r"\d{4}", r"20\d{2}"), ZH.replace(r"\d{4}", r"20\d{2}") + "(?:发布|公布|颁布|印发|批准|核准|审批)"]


@query("x8_publication_date", "select doc_id, <<d:coalesce(" + ", ".join(ymd_sql("content", p) for p in PUB) + ")>> d from citation_zh_v")
def _(v):
    from regulith.functions.dates import publication_date

    return v("citation_zh_v").select("doc_id", publication_date(F.col("content"), ASOF).alias("d"))


@query("x9_date_candidates", f"""with {q.dates(ZH_TEXT)}
 select doc_id, row_number() over (partition by doc_id order by confidence desc, rank, "at", dd, context) - 1 pos, <<d:dd>> "date", context, <<r:confidence>> confidence, rank "pattern" from hit""")
def _(v):
    return e.date_candidates(_dated(v), ASOF)


VALIDATED = f"""{q.dates(ZH_TEXT)},
 ranked as (select *, row_number() over (partition by doc_id order by confidence desc, rank, "at", dd, context) nr from hit),
 alt as (select doc_id, string_agg(<<d:dd>>, ',' order by nr) alternatives from ranked where nr <= 5 group by doc_id),
 own as (select ranked.doc_id, arg_min(confidence, nr) confidence from ranked join dd on dd.doc_id = ranked.doc_id and dd.dd = ranked.dd group by ranked.doc_id),
 checked as (select dd.doc_id, dd.dd, coalesce(dd.dd {q.RANGE}, false) ok, own.confidence, alt.alternatives from dd left join own using (doc_id) left join alt using (doc_id))"""


@query("x10_date_validation", f"""with {VALIDATED} select doc_id, <<d:dd>> effective_date, ok is_valid, <<r:case when ok then coalesce(confidence, 0) else 0 end>> confidence,
 case when dd is null then 'No effective date found' when not ok then 'Date is outside reasonable range' when dd > date '2026-01-01' then 'Future effective date' when date '2026-01-01' - dd > 1825 then 'Effective date is more than 5 years old' end note,
 case when ok then coalesce(alternatives, '') else '' end alternatives from checked""")
def _(v):
    return e.date_validation(_dated(v), ASOF)


@query("k12_top_dates", f"with {VALIDATED} select doc_id, case when ok then coalesce(alternatives, '') else '' end alternatives from checked")
def _(v):
    return e.date_validation(_dated(v), ASOF, keep=5).select("doc_id", "alternatives")


@query("x18_embed_prepare", f"select doc_id, ordinal, substr(regexp_replace({strip_sql('content')}, '\\s+', ' ', 'g'), 1, 8192) text, 'text-embedding' model, <<i:768>> \"dimension\" from {SPLIT}".replace("\\\\s", "\\s"))
def _(v):
    return _prepared(v, 8192)  # the prefix that the reference embeds


@query("x18_embed_prepare_whole", f"select doc_id, ordinal, regexp_replace({strip_sql('content')}, '\\s+', ' ', 'g') text, 'text-embedding' model, <<i:768>> \"dimension\" from {SPLIT}")
def _(v):
    return _prepared(v)


def _prepared(v, max_len=None):
    chunks = c.split_chunks(v("citation_zh_v"))
    prepared = c.embed_prepare(chunks.select(F.col("doc_id").alias("citation_id"), F.col("ordinal").alias("chunk_id"), "content", F.lit("x").alias("province"), F.lit("y").alias("doc_class")), max_len=max_len)
    return prepared.select(F.col("citation_id").alias("doc_id"), F.col("chunk_id").alias("ordinal"), "text", "model", "dimension")
