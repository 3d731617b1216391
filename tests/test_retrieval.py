"""Exact top-k against numpy; both physical forms; hot scopes; score arithmetic."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regulith.functions.vectors import blend
from regulith.plans import retrieval as r

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def tables(spark):
    n, q, dim = 600, 40, 16
    vec = RNG.normal(size=(n, dim)).astype("float32")
    vec[100:140] = vec[100]  # equal vectors must tie by id
    # Two thirds of the citations share one scope.
    scope = ["guangdong"] * 400 + ["shandong"] * 200
    assets = [("wind", "solar", None)[i % 3] for i in range(n)]
    c = pd.DataFrame({"citation_id": [f"c{i:04d}" for i in range(n)], "province": scope, "doc_class": "market_rules", "asset": assets, "embedding": list(vec)})
    qv = RNG.normal(size=(q, dim)).astype("float32")
    qv[0] = vec[100]
    asks = pd.DataFrame({"question_id": range(q), "province": ["guangdong" if i % 2 == 0 else "shandong" for i in range(q)], "doc_class": "market_rules",
                         "asset": [None if i % 3 else "wind" for i in range(q)], "embedding": list(qv)})
    schema = "province string, doc_class string, asset string, embedding array<float>"
    return spark.createDataFrame(asks, "question_id bigint, " + schema), spark.createDataFrame(c, "citation_id string, " + schema).repartition(7), asks, c


def brute(asks, cites, k, threshold=-2.0):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cu = unit(np.stack(cites.embedding).astype(float))
    out = set()
    for _, q in asks.iterrows():
        s = np.round(cu @ (q.embedding.astype(float) / np.linalg.norm(q.embedding.astype(float))), 12)
        ok = (cites.province == q.province) & ((q.asset is None) | (cites.asset == q.asset)) & (s >= threshold)
        order = sorted(np.flatnonzero(ok), key=lambda i: (-s[i], cites.citation_id[i]))[:k]
        out |= {(q.question_id, cites.citation_id[i], rank) for rank, i in enumerate(order, 1)}
    return out


def pairs(df):
    return {(x.question_id, x.citation_id, x["rank"]) for x in df.collect()}


@pytest.mark.parametrize("options", [{}, {"max_broadcast": 0, "q_block": 7, "c_block": 50}, {"seed_from_partitions": 1, "seed_rows": 50}])
def test_topk_is_exact_in_every_form(tables, options):
    asks, cites, pa, pc = tables
    assert pairs(r.vector_topk(asks, cites, 10, **options)) == brute(pa, pc, 10)


def test_threshold(tables):
    asks, cites, pa, pc = tables
    assert pairs(r.vector_topk(asks, cites, 10, threshold=0.3)) == brute(pa, pc, 10, 0.3)


def test_inactive_citations_are_left_out(tables):
    asks, cites, _, pc = tables
    marked = cites.withColumn("superseded_by", F.when(F.col("citation_id") < "c0300", F.lit("c0599")))
    assert {x.citation_id for x in r.vector_topk(asks, marked, 5).collect()} <= set(pc.citation_id[300:])


def test_blend(spark):
    row = spark.createDataFrame([(0.85, 0.75), (0.78, 0.65)], "v double, t double").select(F.round(blend("v", "t"), 6).alias("s")).collect()
    assert [x.s for x in row] == [0.81, 0.728]


def test_cover_density(spark):
    asks = spark.createDataFrame([(1, "alpha beta", "p", "d")], "question_id bigint, question string, province string, doc_class string")
    cites = spark.createDataFrame([("a", "alpha beta x alpha", "p", "d"), ("b", "alpha x x beta", "p", "d"), ("c", "alpha only", "p", "d"), ("d", "alpha beta", "other", "d")],
                                  "citation_id string, content string, province string, doc_class string").withColumn("asset", F.lit(None).cast("string"))
    got = {x.citation_id: x.tscore for x in r.text_rank(asks, cites).collect()}
    # a: spans "alpha beta" and "beta x alpha"; b: one span with two other words.
    assert got == {"a": pytest.approx(0.1 + 0.1 / 2), "b": pytest.approx(0.1 / 3)}


def test_pool_limits_and_ranks(spark, views):
    top = r.hybrid_scores(views("question_vec"), views("citation_emb_v"), pool=15, k=4)
    rows = top.groupBy("question_id").agg(F.max("rank").alias("n"), F.count("*").alias("c")).collect()
    assert all(x.n <= 4 and x.n == x.c for x in rows)


def test_hot_scope_sends_k_rows_per_partition(tables):
    asks, cites, _, _ = tables
    plan = r.vector_topk(asks, cites, 10)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_vectors_of_different_lengths_are_refused():
    import pyarrow as pa

    from regulith.plans.vector_kernel import unit_rows

    with pytest.raises(ValueError, match="lengths"):
        unit_rows(pa.array([[1.0, 2.0, 3.0], [1.0]]))
    assert unit_rows(pa.array([[3.0, 4.0]])).tolist() == [[0.6, 0.8]]
    assert unit_rows(pa.array([[9.0, 9.0], [3.0, 4.0]]).slice(1)).tolist() == [[0.6, 0.8]]
