"""Skewed groups, maintenance, policies, IO, streams on small rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from regulith.operators import aggregates, filters, joins, maintenance, windows
from regulith.plans import answers, ontology, policy
from regulith.sources import ontology_terms, tables, vocab
from regulith.streaming import runner, usage

NOW = dt.datetime(2025, 6, 1)


def test_allowlist_suffix_rule(spark):
    hosts = spark.createDataFrame([("a.gov.cn",), ("gov.cn",), ("evilgov.cn",), ("x.gzpec.cn",), ("gzpec.cn",), ("notgzpec.cn",), (None,)], "domain string")
    allow = spark.createDataFrame([(".gov.cn",), ("gzpec.cn",)], "domain string")
    assert {r.domain for r in filters.allow_domains(hosts, allow).collect()} == {"a.gov.cn", "x.gzpec.cn", "gzpec.cn"}
    assert {r.domain for r in filters.allow_domains(hosts, allow, anti=True).collect()} == {"gov.cn", "evilgov.cn", "notgzpec.cn", None}


def test_allowlist_plan_has_no_pairs(spark):
    hosts = spark.range(10).select(F.concat(F.col("id").cast("string"), F.lit(".gov.cn")).alias("domain"))
    plan = filters.allow_domains(hosts, hosts)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_containment_equals_brute_force(spark):
    texts = ["the quick brown fox jumps over the dog", "quick brown fox", "a fox", "own fo", "dog", "zzz the quick brown fox jumps", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    clauses = spark.createDataFrame(list(enumerate(["quick brown fox jumps over", "brown fox", "own fo", "dog", "e quick brown fox ju", "missing words here now"])), "item_id bigint, clause string")
    got = {(r.item_id, r.doc_id) for r in joins.contained_in(clauses, docs, "item_id", "clause", "doc_id", "text").collect()}
    want = {(i, j) for i, c in enumerate(["quick brown fox jumps over", "brown fox", "own fo", "dog", "e quick brown fox ju", "missing words here now"]) for j, t in enumerate(texts) if c in t}
    assert got == want


def test_hot_key_running_average(spark):
    # One key holds most rows; its history spans several buckets.
    rows = spark.range(2000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), "id", (F.col("id") % 7).cast("double").alias("x"))
    got = {r.id: r.running_avg for r in windows.running_average(rows, ["k"], "ts", "id", "x").collect()}
    sums, counts = {}, {}
    for i in range(2000):
        k = "hot" if i % 10 < 9 else "cold"
        sums[k], counts[k] = sums.get(k, 0) + i % 7, counts.get(k, 0) + 1
        assert got[i] == pytest.approx(sums[k] / counts[k])


def test_hot_key_trailing_usage(spark):
    rows = spark.range(500).select(F.lit("hot").alias("k"), "id", F.timestamp_micros(F.col("id") * 7_000_000).alias("ts"))
    got = {r.id: r.used for r in usage.trailing_usage(rows, "k", "id", 60, 5).collect()}
    assert got == {i: min(i, 8) + 1 for i in range(500)}


def test_hot_document_offsets(spark):
    rows = spark.range(50).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), F.repeat(F.lit("x"), (F.col("id") % 4 + 1).cast("int")).alias("content"))
    got = {r.pos: (r.start_char, r.end_char) for r in windows.cumulative_offsets(rows).collect()}
    at = 0
    for i in range(50):
        assert got[i] == (at, at + i % 4 + 1)
        at += i % 4 + 1


def test_sessions(spark):
    base = dt.datetime(2024, 1, 1)
    seconds = [0, 1000, 1799 + 1000, 4600, 9000]
    rows = spark.createDataFrame([("t", base + dt.timedelta(seconds=s)) for s in seconds], "trace_id string, created_at timestamp")
    got = sorted((r.session, r.entries) for r in usage.trace_sessions(rows).collect())
    assert got == [(1, 3), (2, 1), (3, 1)]


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 10, 20, 30, 40)] + [(None,)], "v double")
    row = aggregates.latency_percentiles(df, "v").first()
    assert (row.n, row.p50, row.p95) == (4, 25.0, pytest.approx(38.5))


def test_topk_prunes_before_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = windows.topk_per_key(df, ["k"], [F.col("id").desc()], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_upsert_last_writer_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1)], "k string, v int, seq int")
    merged, counts = maintenance.upsert(old, new, ["k"], ["v"], NOW, order="seq")
    assert {(r.k, r.v, r.change) for r in merged.collect()} == {("a", 1, "kept"), ("b", 6, "updated"), ("c", 7, "inserted")}
    assert {(r.change, r["count"]) for r in counts.collect()} == {("kept", 1), ("updated", 1), ("inserted", 1)}
    assert {r.k for r in merged.filter("updated_at is not null").collect()} == {"b", "c"}


def test_delete_needs_a_criterion(spark):
    with pytest.raises(ValueError):
        maintenance.delete_where(spark.createDataFrame([("a", "x")], "citation_id string, province string"))


def test_duplicates_point_to_the_first(spark):
    rows = [(i, "same" if i % 2 else f"h{i}", NOW + dt.timedelta(minutes=i)) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id bigint, checksum string, fetched_at timestamp")
    assert {r.page_id: r.duplicate_of for r in joins.mark_duplicates(df).collect()} == {0: None, 1: None, 2: None, 3: 1, 4: None, 5: 1, 6: None, 7: 1, 8: None}


def test_guardrail_order(spark):
    cols = "question_id bigint, rank int, citation_id string, url string, checksum string, effective_date date, province string, doc_class string, superseded_by string"
    day = dt.date(2024, 1, 1)
    ok = "https://a.gov.cn/x"
    rows = [(1, 1, "a", ok, "h", day, "guangdong", "market_rules", None), (2, 1, "a", ok, "h", None, "guangdong", "market_rules", None), (2, 2, "b", ok, None, day, "guangdong", "market_rules", None),
            (3, 1, "a", "https://gzpec.cn/x", "h", day, "guangdong", "market_rules", None), (4, 1, "a", "https://bad.com/x", "h", day, "guangdong", "market_rules", "z"),
            (5, 1, "a", ok, "h", day, "guangdong", "market_rules", "z"), (7, 1, "a", ok, "h", day, "guangdong", "market_rules", None)]
    asks = spark.createDataFrame([(i, "narnia" if i == 7 else "guangdong", "market_rules") for i in range(1, 8)], "question_id bigint, province string, doc_class string")
    allow = spark.createDataFrame([(".gov.cn",), ("gzpec.cn",)], "domain string")
    dummy = spark.createDataFrame([("gzpec.cn",)], "domain string")
    got = {r.question_id: r.refusal_reason for r in policy.guardrails(spark.createDataFrame(rows, cols), asks, allow, dummy).collect()}
    assert got == {1: None, 2: "missing_effective_date", 3: "placeholder_url_detected", 4: "domain_not_allowed", 5: "superseded_citation", 6: "no_first_party_citation", 7: "province_mismatch"}


def test_answer_text(spark):
    meta = "struct<title:string,url:string,effective_date:string>"
    rows = [(1, "c1", 1, 0.9, "应提交申请资料。", ("规则甲", "u1", "2024-01-01")), (1, "c2", 2, 0.8, "并网电压为110KV。", ("规则乙", "u2", "2024-02-01")), (1, "c3", 3, 0.7, "无日期", ("规则丙", "u3", None))]
    results = spark.createDataFrame(rows, f"question_id bigint, citation_id string, rank int, score double, passage string, metadata {meta}")
    asks = spark.createDataFrame([(1, "guangdong", "grid_connection", "solar", "zh"), (2, "shandong", "dispatch_ops", None, "zh")], "question_id bigint, province string, doc_class string, asset string, lang string")
    got = {r.question_id: r for r in answers.compose_answers(results, asks).collect()}
    assert got[1].answer_zh == "**并网要点（广东 / 光伏）**\n- 资料清单：\n  • 应提交申请资料。 〔《规则甲》，生效：2024-01-01〕\n- 并网条件：\n  • 并网电压为110KV。 〔《规则乙》，生效：2024-02-01〕"
    assert (got[1].sections, got[1].total_citations, [c.citation_id for c in got[1].citations]) == (2, 2, ["c1", "c2"])
    assert got[2].answer_zh == "抱歉，没有找到相关的一手资料。请尝试更具体的问题或联系相关部门获取最新信息。"


GUANGDONG = "广东省电网接入管理办法 第二条：风力发电项目接入电网应当符合以下技术要求：（一）装机容量不少于50MW；（二）电压等级为110KV或以上。"


def test_ontology(spark):
    docs = spark.createDataFrame([("a", GUANGDONG), ("b", "山东省电力调度运行规程：煤电机组应当具备调峰能力"), ("c", "没有")], "citation_id string, content string")
    found = {r.citation_id: r for r in ontology.entities(docs).collect()}
    assert found["a"].jurisdictions == ["guangdong"] and "wind" in found["a"].assets and "capacity" in found["a"].parameters
    assert found["b"].jurisdictions == ["shandong"] and found["b"].assets == ["coal"] and "dispatch_ops" in found["b"].markets
    low = ontology.Thresholds(jurisdiction=0.1, market=0.1, asset=0.1, overall=0.1)
    best = {r.citation_id: r for r in ontology.ontology_map(docs, thresholds=low).filter("rank = 1").collect()}
    assert best["a"].path.startswith("guangdong → grid_connection → wind")
    # A text without any entity gets the general mapping: (0.8 + 0.4 + 0.3 * 3) / 5.
    assert best["c"].overall_confidence == pytest.approx(0.42)


def test_fuzzy_keywords(spark):
    docs = spark.createDataFrame([("a", "turbne maintenence")], "citation_id string, content string")
    row = ontology.keyword_confidence(docs, {"m": ["maintenance", "repair"], "w": ["turbine"]}, 0.8).first()
    assert row.m == pytest.approx((1 - 1 / 11) / 2) and row.w == pytest.approx(1 - 1 / 7)


def test_csv_export(spark, tmp_path):
    cols = "signal_id string, title string, tags array<string>, province string, asset_type string, signal_type string, priority string, published_date date, deadline_date date, impact_score double, relevance_score double"
    df = spark.createDataFrame([("s1", "光伏", ["a", "b"], "gd", "solar", "policy", "high", dt.date(2025, 1, 1), None, 0.5, 0.6)], cols)
    tables.export_signals_csv(df, filters.SignalFilter(), str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert lines[0].value.split(",")[:3] == ["Signal ID", "Title", "Title (EN)"] and len(lines[0].value.split(",")) == 18
    assert '"a, b"' in lines[1].value


def test_jsonl_keeps_cjk(spark, tmp_path):
    tables.write_jsonl(spark.createDataFrame([("并网", None)], "t string, n string"), str(tmp_path / "j"))
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"t":"并网","n":null}']


def test_layout_json_reads_nested(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('{"doc_id": 1, "url": "u", "text": "abc", "pages": [{"blocks": [{"layout": {"confidence": 0.5, "text_anchor": {"text_segments": [{"start_index": 0, "end_index": 3}]}}}]}]}', encoding="utf8")
    row = tables.read_layout_json(spark, str(path)).first()
    assert row.pages[0].blocks[0].layout.text_anchor.text_segments[0].end_index == 3


def test_late_rows_are_dropped_by_the_stream(spark, tmp_path):
    schema = "user_id bigint, ts timestamp"
    base = dt.datetime(2024, 1, 1, 12)
    for i, when in enumerate([base, base + dt.timedelta(hours=2), base - dt.timedelta(hours=3), base + dt.timedelta(hours=4)]):
        spark.createDataFrame([(1, when)], schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}.parquet"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = runner.run_update(usage.requests_per_minute(stream), ["user_id", "minute"], "late")
    minutes = {r.minute for r in out.collect()}
    assert base in minutes and base + dt.timedelta(hours=4) in minutes and base - dt.timedelta(hours=3) not in minutes


def test_session_stream(spark, tmp_path):
    schema = "trace_id string, created_at timestamp"
    base = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("t", base), ("t", base + dt.timedelta(minutes=5)), ("t", base + dt.timedelta(hours=2))], schema).coalesce(1).write.parquet(str(tmp_path / "in/a.parquet"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = runner.run_append(usage.session_stream(stream, "trace_id", "created_at", "30 minutes"), "sessions")
    # The last session stays open until the watermark passes it.
    assert [(r.started_at, r.entries) for r in out.collect()] == [(base, 2)]


def test_vocabulary_tables_agree():
    assert set(vocab.ASSET_ALIASES.values()) == set(vocab.ASSETS) and set(vocab.PROVINCE_ALIASES.values()) == set(vocab.PROVINCES)
    assert set(ontology_terms.LEVELS) == set(ontology.LEVEL_COLUMNS)


def test_format_checks(spark):
    from regulith.functions import checks

    long = "a" * 63
    cases = {
        checks.is_domain: (["gov.cn", "a.b-c.example.com", f"{long}.org", "9x.io"], ["gov", "-a.com", "a-.com", "a..com", ".com", "a.c", "a.c1", "a b.com", f"{long}a.org", "", None]),
        checks.is_url: (
            ["http://gov.cn", "HTTPS://www.Example.com/a?b=c#d", "http://localhost:8080", "http://10.0.0.1/x", " http://a.cn/ ", "http://a.cn?q", "http://a.com."],
            ["ftp://a.cn", "http://", "http://a", "http://a.cn:x/", "http://a.cn/a b", "http://a.toolong", "http://a.cn?", "a.cn", "http://1.2.3", "http://a.cn:", None]),
        checks.is_cadence: (
            ["P1D", "P2DT6H", "PT90M", "R/2025-01-01T00:00:00Z/P1D", "P1Y2M3DT4H5M6S", "P"],
            ["1D", "P1H", "PD", "P1DT1D", "R/2025-01-01/P1D", "R/P1D", "x/2025-01-01T00:00:00Z/P1D", "P1D ", "", None]),
    }
    for check, (good, bad) in cases.items():
        rows = spark.createDataFrame([(v,) for v in good + bad], "v string").select("v", check("v").alias("ok")).collect()
        assert [r.v for r in rows if r.ok] == good


def test_contained_in_without_word_borders(spark):
    import random

    rng = random.Random(1)
    alphabet = "风电项目并网管理办法，。 ab c9"
    docs = [(i, "".join(rng.choice(alphabet) for _ in range(60))) for i in range(30)]
    clauses = []
    for i in range(150):
        text, n = rng.choice(docs)[1], rng.choice([1, 1, 2, 2, 3, 4, 5, 8, 15])
        at = rng.randrange(60 - n)
        clauses.append((i, text[at : at + n] + ("x" if i % 10 == 0 else "")))
    clauses += [(150, ""), (151, None)]
    out = joins.contained_in(spark.createDataFrame(clauses, "c int, t string"), spark.createDataFrame(docs, "d int, t string"), "c", "t", "d", "t")
    assert {(r.c, r.d) for r in out.collect()} == {(c, d) for c, t in clauses if t for d, x in docs if t in x}


def test_chinese_pairs(spark):
    from regulith.functions.text import simple_tokens

    rows = spark.createDataFrame([("广东省ab50MW电 力并网",), ("Plain words_1",), (None,)], "t string").select(simple_tokens("t").alias("x")).collect()
    assert [r.x for r in rows] == [["广东", "东省", "ab50mw", "电", "力并", "并网"], ["plain", "words_1"], None]


def test_upsert_takes_the_last_of_equal_keys(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("b", 4, 1)], "k string, v int, seq int")
    merged, _ = maintenance.upsert(old, new, ["k"], ["v"], NOW, order="seq")
    assert {(r.k, r.v, r.change) for r in merged.collect()} == {("a", 3, "updated"), ("b", 4, "inserted")}
    with pytest.raises(ValueError):
        maintenance.upsert(old, new, ["k"], ["v"], NOW, order=[])


def test_delete_reaches_rows_without_chunk(spark):
    rows = spark.createDataFrame([("a", None, "x"), ("a", "1", "x"), ("b", None, "y"), (None, "1", None)], "citation_id string, chunk_id string, province string")
    left = lambda df: sorted(str((r.citation_id, r.chunk_id)) for r in df.collect())
    assert left(maintenance.delete_where(rows, province="x")) == left(rows.where("province is distinct from 'x'"))
    ids = spark.createDataFrame([("a",), ("a",)], "citation_id string")
    assert left(maintenance.delete_where(rows, citation_ids=ids)) == ["('b', None)", "(None, '1')"]
    chunks = spark.createDataFrame([("1",)], "chunk_id string")
    assert left(maintenance.delete_where(rows, citation_ids=ids, chunk_ids=chunks)) == ["('a', None)", "('b', None)", "(None, '1')"]


def test_supersession_on_the_citation_schema(spark):
    from regulith.operators.windows import superseded_map

    rows = spark.createDataFrame([("c1", "u", "2020-01-01"), ("c2", "u", "2021-01-01"), ("c3", "v", "2021-01-01")], "citation_id string, url string, effective_date string")
    assert [(r.old_id, r.new_id) for r in superseded_map(rows, ["url"]).collect()] == [("c1", "c2")]


def test_equal_documents_give_their_text_once(spark):
    from regulith.plans.ontology import combined_text

    chunks = spark.createDataFrame([("c", 0, "one", 1), ("c", 1, "two", 1), ("c", 0, "one", 2), ("c", 1, "two", 2)], "citation_id string, pos int, content string, doc_id int")
    assert [r.content for r in combined_text(chunks).collect()] == ["one\ntwo"]


def test_building_a_plan_runs_no_job(spark, views):
    texts, items = views("citation_zh_v"), views("benchmark")
    context = spark.sparkContext
    context.setJobGroup("building", "plans only")
    try:
        ontology.ontology_map(texts)
        joins.contained_in(items, texts, "item_id", "text", "doc_id", "content")
        ontology.entities(texts)
        assert list(context.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
