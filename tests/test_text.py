"""Text rules, chunking and dates on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from regulith.functions import dates, layout, text
from regulith.plans import chunking, effective_dates

AS_OF = dt.date(2025, 12, 1)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr("c").alias("r")).first().r


@pytest.mark.parametrize("value,expected", [
    ("第 一 条 内容", "第一条内容"), ("2025 年 3 月 1 日", "2025年3月1日"), ("   ", ""), (None, ""), ("这是一个  测试   文档。", "这是一个测试文档。"),
    ("第一条 ： 这是条款。 第二条 ； 另一条款。", "第一条：这是条款。第二条；另一条款。"), ("ＡＢＣ１２", "ABC12"), ("a b", "a b"), ("a\n\n\n\nb", "a\n\nb"),
])
def test_normalize_cjk(spark, value, expected):
    assert one(spark, value, text.normalize_cjk) == expected


@pytest.mark.parametrize("value,expected", [("", 0), ("   ", 1), ("能源电力", 6), ("two words", 3), ("并网50MW", 4)])
def test_token_estimate(spark, value, expected):
    assert one(spark, value, text.token_estimate) == expected


def test_passage_cuts_at_sentence(spark):
    body = "甲" * 300 + "。" + "乙" * 400
    assert one(spark, body, text.passage) == "甲" * 300 + "。"
    assert one(spark, "x" * 600, text.passage) == "x" * 500 + "..."
    assert one(spark, None, text.passage) == ""


def test_key_clause(spark):
    assert one(spark, "短句", text.key_clause) == "短句"
    assert one(spark, "甲" * 120 + "。" + "乙" * 50, text.key_clause) == "甲" * 120 + "。"
    assert one(spark, "甲" * 200, text.key_clause) == "甲" * 147 + "..."


def test_ocr_cleaning(spark):
    assert one(spark, "3O7 | 50  兆瓦 1l2", text.clean_ocr) == "307  50兆瓦 112"


@pytest.mark.parametrize("value,url,expected", [
    ("本规则自2025年3月1日起施行。", "", "2025-03-01"), ("自2025年6月15日起执行", "", "2025-06-15"), ("发布日期：2025年2月20日", "", "2025-02-20"),
    ("有效期至2025-12-31", "", "2025-12-31"), ("粤能规〔2025〕15号", "", "2025-01-01"), ("没有日期", "http://a.gov.cn/2024/05/06/x", "2024-05-06"),
    ("没有日期", "http://a.gov.cn/20240230/x", None), ("申请截止日期为2025年6月30日", "", None),
    ("首段。" + "字" * 300 + "本办法自2024年1月1日起施行", "", "2024-01-01"), ("旧文2001年1月1日发布。" + "字" * 300 + "本办法自2024年1月1日起施行", "", "2024-01-01"),
    ("发布日期：2025年13月40日，2024年5月1日发布", "", "2024-05-01"),
])
def test_effective_date(spark, value, url, expected):
    docs = spark.createDataFrame([(1, value, url)], "doc_id bigint, text string, url string")
    found = effective_dates.effective_date(docs, AS_OF).first().effective_date
    assert (found.isoformat() if found else None) == expected


def test_simple_date_rejects_future(spark):
    docs = spark.createDataFrame([(1, "2030年1月1日 2020-05-06", "")], "doc_id bigint, text string, url string")
    assert effective_dates.effective_date_simple(docs, AS_OF).first().effective_date == dt.date(2020, 5, 6)


def test_matches_keep_their_place(spark):
    body = "x2020-01-02yy2021/3/4z"
    rows = spark.createDataFrame([(body,)], "c string").select(dates.matches_at(F.col("c"), r"20\d{2}[-/]\d{1,2}[-/]\d{1,2}").alias("m")).first().m
    assert [(r.m, r.at) for r in rows] == [("2020-01-02", 2), ("2021/3/4", 14)]


def test_date_candidates_and_validation(spark):
    body = "发布日期：2025年2月20日。" + "字" * 150 + "自2025年3月1日起施行" + "字" * 400 + "申请截止2024-01-01"
    docs = spark.createDataFrame([(1, body, "")], "doc_id bigint, text string, url string")
    rows = effective_dates.date_candidates(docs, AS_OF).orderBy("pos").collect()
    # The issue pattern near the start: 0.5 + 0.3 + 0.2 + 0.1, capped at 1.
    assert rows[0].date == dt.date(2025, 2, 20) and rows[0].confidence == 1.0
    # A late date between excluding words: 0.5 - 0.3.
    assert rows[-1].date == dt.date(2024, 1, 1) and rows[-1].confidence == pytest.approx(0.2)
    report = effective_dates.date_validation(docs, AS_OF).first()
    assert report.is_valid and report.effective_date == dt.date(2025, 3, 1) and report.alternatives[0] == "2025-02-20"
    assert len(report.alternatives) <= 5


def chunks_of(spark, paras, **kw):
    docs = spark.createDataFrame([(7, paras)], "doc_id bigint, paragraphs array<string>")
    return chunking.chunk_document(docs, **kw).orderBy("pos").collect()


def test_clauses_split_before_their_marker(spark):
    df = spark.createDataFrame([(["第一条：应当符合要求。第二条：规定如下：（一）装机容量不少于3.5MW；（二）小时数。"],)], "p array<string>")
    parts = df.select(chunking.split_clauses("p", 1).alias("c")).first().c
    assert any(p.startswith("第一条") for p in parts) and any(p.startswith("第二条") for p in parts)
    assert any(p.startswith("（一）") for p in parts) and any("3.5MW" in p for p in parts)


def test_packing_keeps_every_clause(spark):
    clauses = [f"第{n}条：" + "内容" * size for n, size in zip("一二三四五六七八", (10, 40, 5, 60, 3, 3, 200, 8))]
    df = spark.createDataFrame([(clauses,)], "c array<string>")
    packed = df.select(chunking.pack_clauses("c", 100, 20).alias("p")).first().p
    flat = [c for k in packed for c in k.clauses]
    assert [c for i, c in enumerate(flat) if c not in flat[:i]] == clauses
    assert all(k.tokens <= 100 or len(k.clauses) == 1 for k in packed)


def test_packing_overlaps(spark):
    clauses = ["第一条：短内容甲。", "第二条：短内容乙。", "第三条：短内容丙。", "第四条：短内容丁。"]
    df = spark.createDataFrame([(clauses,)], "c array<string>")
    packed = df.select(chunking.pack_clauses("c", 30, 15).alias("p")).first().p
    assert len(packed) > 1 and packed[1].clauses[0] == packed[0].clauses[-1]


def test_short_chunks_merge_once(spark):
    schema = "k array<struct<clauses:array<string>,tokens:int>>"
    df = spark.createDataFrame([([(["a"], 10), (["b"], 20), (["c"], 700), (["d"], 30)],)], schema)
    merged = df.select(chunking.merge_short_chunks("k").alias("m")).first().m
    assert [(m.clauses, m.tokens) for m in merged] == [(["a", "b"], 30), (["c"], 700), (["d"], 30)]


def test_chunk_ids_are_stable_and_placed(spark):
    paras = ["第一条：" + "电" * 60 + "。", "第二条：" + "网" * 60 + "。"]
    first, second = chunks_of(spark, paras), chunks_of(spark, paras)
    assert [c.chunk_id for c in first] == [c.chunk_id for c in second] and first[0].start_char == 0
    assert first[0].clause_type == "article"


def test_chunk_text_overlap(spark):
    body = "\n\n".join(["甲" * 50, "乙" * 50, "丙" * 50])
    rows = chunking.chunk_text(spark.createDataFrame([(1, body)], "doc_id bigint, text string"), 100, 10).orderBy("pos").collect()
    assert [r.chunk_id for r in rows] == ["chunk_001", "chunk_002", "chunk_003"]
    assert rows[1].content.startswith("甲" * 10 + "\n\n" + "乙") and rows[1].start_pos == len(rows[0].content)


@pytest.mark.parametrize("value,expected", [
    ("第十条 x", "article"), ("（一）x", "numbered_item"), ("储能是指电池", "definition"), ("应当提交", "requirement"), ("不得操作", "prohibition"),
    ("按流程", "procedure"), ("技术规范", "standard"), ("| a | b | c |", "table"), ("其他", "general"),
])
def test_clause_type(spark, value, expected):
    assert one(spark, value, chunking.clause_type) == expected


def test_merge_short_paragraphs(spark):
    df = spark.createDataFrame([(["aa", "bb", "c" * 60, "dd"],)], "p array<string>")
    assert df.select(layout.merge_short("p", 50).alias("m")).first().m == ["aa\nbb\n" + "c" * 60, "dd"]


SEG = "struct<layout:struct<confidence:double,text_anchor:struct<text_segments:array<struct<start_index:int,end_index:int>>>>>"


def test_paragraph_fallbacks(spark):
    body = "第一条：这是第一条内容。\n第二条：这是第二条内容。"
    block = lambda a, b: {"layout": {"confidence": 0.9, "text_anchor": {"text_segments": [{"start_index": a, "end_index": b}]}}}
    schema = f"text string, pages array<struct<blocks:array<{SEG}>>>"
    rows = [(body, [{"blocks": [block(0, 12), block(13, 25)]}]), (body + "\n\n" + "另一个足够长的段落在这里。", [{"blocks": []}]), ("短\n\n" + "line one\nline two", None)]
    got = [r.p for r in spark.createDataFrame(rows, schema).select(layout.paragraphs("text", "pages").alias("p")).collect()]
    assert len(got[0]) == 2 and got[0][1].startswith("第二条")
    assert len(got[1]) == 2
    assert got[2] == ["line one\nline two"]


def test_ragged_table(spark):
    row = spark.range(1).select(layout.table_markdown(F.array(F.array(F.lit("a"), F.lit("b"))), F.array(F.array(F.lit("1")))).alias("t")).first().t
    assert row.markdown == "| a | b |\n| --- | --- |\n| 1 |  |" and (row.row_count, row.col_count) == (2, 2)
