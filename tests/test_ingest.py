"""Ingest keeps whole documents; what is too short to be chunked stays in the citation."""

import datetime as dt

from pyspark.sql import functions as F

from regulith.operators.aggregates import ocr_metrics
from regulith.operators.filters import store_candidates
from regulith.plans import ingest

OLD = "citation_id string, province string, doc_class string, asset string, title string, url string, effective_date date, checksum string, content string"


def test_citations_store_the_whole_text(spark):
    long = "第一条 " + "发电企业应当按照规定办理并网手续并提交材料" * 4
    texts = {1: "短文。", 2: long + "\n\n附则\n\n" + "另外" + "本办法自发布之日起施行并由主管部门负责解释" * 3, 3: long}
    docs = spark.createDataFrame([(k, f"http://a/{k}", "t", "ASIA", "rule", t) for k, t in texts.items()], "doc_id bigint, url string, title string, province string, doc_class string, text string")
    out = ingest.ingest_batch(docs, spark.createDataFrame([], OLD), dt.datetime(2024, 1, 30), max_tokens=60, overlap=40, min_clause=10)
    got = {r.url: (r.content, r.change) for r in out.citations.collect()}
    assert got == {f"http://a/{k}": (t, "inserted") for k, t in texts.items()}
    assert {r.change: r["count"] for r in out.changes.collect()} == {"inserted": 3}
    assert out.chunks.where(F.col("doc_id") == 1).count() == 0


def test_jobs_tell_what_became_of_each_document(spark):
    long = "第一条 自2024年3月1日起施行" + "发电企业应当按照规定办理并网手续并提交材料" * 4
    texts = {1: "短文。", 2: long, 3: "这一段文字超过十个字但没有条款", 4: ""}
    docs = spark.createDataFrame([(k, f"http://a/{k}", "t", "ASIA", "rule", t) for k, t in texts.items()], "doc_id bigint, url string, title string, province string, doc_class string, text string")
    out = ingest.ingest_batch(docs, spark.createDataFrame([], OLD), dt.datetime(2024, 6, 30), max_tokens=400, overlap=40, min_clause=20)
    got = {r.job_id: (r.status, r.error, r.effective_date_found, r.chunks > 0) for r in out.jobs.collect()}
    assert got == {1: ("failed", ingest.NO_CONTENT, False, False), 2: ("success", None, True, True), 3: ("failed", ingest.NO_CHUNKS, False, False), 4: ("failed", ingest.NO_CONTENT, False, False)}
    report = ocr_metrics(out.jobs).first()
    assert (report.total_jobs, report.successful_jobs, report.failed_jobs, report.total_pages) == (4, 1, 3, 4)


def test_dropped_candidates_are_counted_on_the_writing_pass(spark, tmp_path):
    rows = [(1, "a.gov.cn", "https://a.gov.cn/x", 0.9), (2, "a.gov.cn", "ftp://a.gov.cn/x", 0.9), (3, "b.com", "https://b.com", 0.9), (4, "a.gov.cn", "https://a.gov.cn/y", 0.1)]
    df = spark.createDataFrame(rows, "candidate_id int, domain string, url string, confidence_score double")
    allow = spark.createDataFrame([("a.gov.cn",)], "domain string")
    counts = store_candidates(df, allow, str(tmp_path / "kept"))
    assert counts == {"kept_count": 1, "filtered_count": 3}
    assert [r.candidate_id for r in spark.read.parquet(str(tmp_path / "kept")).collect()] == [1]
