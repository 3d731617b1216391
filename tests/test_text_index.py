"""The positional index: places of terms, what a search reads, Chinese pairs, stored indexes, empty and null texts."""

import re

import pytest
from pyspark.sql import functions as F

from regulith.plans import retrieval as r
from regulith.plans.text_index import BUCKETS, EVERY, build_index, read_index

CITATIONS = "citation_id string, province string, doc_class string, asset string, content string"
ROWS = [
    ("a", "p", "d", None, "alpha beta x Alpha"), ("b", "p", "d", "wind", "alpha x x beta"), ("c", "p", "d", None, "alpha only"),
    ("d", "other", "d", None, "alpha beta"), ("e", "p", "d", None, None), ("f", "p", "d", None, ""), ("g", "p", "d", "solar", "风电项目并网 alpha_1"),
    ("h", "p", "d", None, "并网 风电 项目"), ("i", "p", "d", None, "beta " * 3000 + "alpha"),
]
ASKS = "question_id bigint, question string, province string, doc_class string, asset string"


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(ROWS, CITATIONS).repartition(3))


def ask(spark, *rows):
    return spark.createDataFrame([(i, q, "p", "d", asset) for i, (q, asset) in enumerate(rows)], ASKS)


def test_places_of_every_term(index):
    got = {(x.term, x.citation_id): (x.positions, x.length) for x in index.postings.collect()}
    assert got["alpha", "a"] == ([1, 4], 4) and got["beta", "a"] == ([2], 4)
    assert got[EVERY, "e"] == ([0], 0) and got[EVERY, "f"] == ([0], 0)
    assert got["风电", "g"] == ([1], 6) and got["电项", "g"] == ([2], 6) and got["alpha_1", "g"] == ([6], 6)
    assert len(got["beta", "i"][0]) == 3000 and got["alpha", "i"] == ([3001], 3001)
    assert sum(1 for t, _ in got if t == EVERY) == len(ROWS)


def test_terms_hold_frequencies_and_bounds(index):
    got = {(x.term, x.province): (x.df, x.max_tf, x.min_length) for x in index.terms.collect()}
    assert got["alpha", "p"] == (4, 2, 2) and got["alpha", "other"] == (1, 1, 2) and got["beta", "p"] == (3, 3000, 4)


def test_a_search_reads_the_partitions_of_its_terms(spark, index):
    hits = index.of(spark.createDataFrame([("alpha",)], "term string"))
    assert {x.citation_id for x in hits.collect()} == {"a", "b", "c", "d", "i"}
    plan = hits._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    assert len({x.bucket for x in index.postings.select("bucket").distinct().collect()}) <= BUCKETS


def test_hits_hold_all_terms_in_scope_and_asset(spark, index):
    asks = ask(spark, ("Alpha beta", None), ("alpha beta", "wind"), ("alpha nowhere", None), ("", None), ("项目并网", None), ("only", "wind"))
    got = {(x.question_id, x.citation_id) for x in r.text_hits(asks, index).collect()}
    assert got == {(0, "a"), (0, "b"), (0, "i"), (1, "b"), (4, "g")}  # h has no pair that runs over a space


def test_rank_of_given_pairs_only(spark, index):
    pairs = spark.createDataFrame([(0, "b"), (0, "c")], "question_id bigint, citation_id string")
    got = {x.citation_id: x.tscore for x in r.text_rank(ask(spark, ("alpha beta", None)), index, pairs=pairs).collect()}
    assert got == {"b": pytest.approx(0.1 / 3)}


def test_chinese_cover_density(spark, index):
    got = {x.citation_id: x.tscore for x in r.text_rank(ask(spark, ("风电项目", None)), index).collect()}
    assert got == {"g": pytest.approx(0.1)}


def test_a_stored_index_is_read_without_the_texts(spark, tmp_path):
    path = str(tmp_path / "index")
    build_index(spark.createDataFrame(ROWS, CITATIONS), path)
    index = read_index(spark, path)
    ranked = r.text_rank(ask(spark, ("alpha beta", None)), index)
    assert {x.citation_id for x in ranked.collect()} == {"a", "b", "i"}
    plan = ranked._jdf.queryExecution().toString()
    assert "content" not in plan and not re.search(r"tokens|BroadcastNestedLoopJoin|CartesianProduct", plan)


def test_bm25_of_an_index_equals_plain_sums(spark, index):
    import math

    pairs = spark.createDataFrame([(0, x) for x in "abcdefghi"], "question_id bigint, citation_id string")
    got = {x.citation_id: x.tscore for x in r.bm25(ask(spark, ("alpha beta", None)), pairs, index).collect()}
    texts = {row[0]: re.findall(r"\w+", (row[4] or "").lower()) for row in ROWS if row[0] not in "gh"} | {"g": ["风电", "电项", "项目", "目并", "并网", "alpha_1"], "h": ["并网", "风电", "项目"]}
    mean = sum(map(len, texts.values())) / len(texts)
    want = {}
    for k, words in texts.items():
        for t in ("alpha", "beta"):
            tf, df = words.count(t), sum(t in w for w in texts.values())
            if tf:
                want[k] = want.get(k, 0) + math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_hybrid_search_with_the_cover_density(spark):
    rows = [(f"c{i}", "p", "d", None, "风电项目并网" if i % 2 else "其他内容", [1.0, float(i)]) for i in range(6)]
    cites = spark.createDataFrame(rows, CITATIONS + ", embedding array<double>")
    asks = ask(spark, ("风电项目", None)).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    got = r.hybrid_scores(asks, cites, k=3, text_score="text_rank").collect()
    score = {f"c{i}": 0.6 / (1 + i * i) ** 0.5 + 0.4 * (0.1 if i % 2 else 0) for i in range(6)}
    best = sorted(score, key=lambda c: -score[c])[:3]
    assert [x.citation_id for x in sorted(got, key=lambda x: x["rank"])] == best
    assert all(x.score == pytest.approx(score[x.citation_id]) for x in got)
