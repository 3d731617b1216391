"""Dictionary operators against every pair."""

import random

import pytest

from regulith.operators import dictionary

RNG = random.Random(12)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def damaged(word, n):
    for _ in range(n):
        at, kind = RNG.randrange(len(word) + 1), RNG.randrange(3)
        word = word[:at] + (RNG.choice("abc并") if kind else "") + word[at + (kind < 2) :]
    return word


@pytest.mark.parametrize("least", [0.8, 0.75])
def test_near_terms_equal_all_pairs(spark, least):
    terms = {"".join(RNG.choice("abcde网") for _ in range(RNG.randrange(1, 40))) for _ in range(120)}
    words = {damaged(t, RNG.randrange(0, 1 + len(t) // 4)) for t in terms for _ in range(3)} | {"ab", "a", "", None}
    got = {(r.word, r.term) for r in dictionary.near_terms(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string"), least).collect()}
    want = {(w, t) for w in words if w for t in terms if 1 - distance(w, t) / max(len(w), len(t)) >= least}
    assert got == want and len(want) > 100


def test_near_terms_join_by_keys(spark):
    plan = dictionary.near_terms(spark.createDataFrame([("a",)], "word string"), spark.createDataFrame([("b",)], "term string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contained_terms(spark, monkeypatch):
    texts = [(k, "".join(RNG.choice("abc 网并") for _ in range(RNG.randrange(200)))) for k in range(60)] + [(60, None), (61, ""), (62, "abc" * 30_000)]
    terms = {"".join(RNG.choice("abc 网并") for _ in range(RNG.randrange(1, 6))) for _ in range(400)}
    docs = spark.createDataFrame(texts, "id bigint, text string").repartition(3)
    table = spark.createDataFrame([(t,) for t in [*terms, "", None, next(iter(terms))]], "term string")
    want = {(k, t, x.index(t) + 1) for k, x in texts for t in terms if x and t in x}
    for size in (1 << 20, 100):
        monkeypatch.setattr(dictionary, "BLOCK_CHARS", size)
        got = dictionary.contained_terms(docs, table, "id", "text").collect()
        assert {(r.id, r.term, r.position) for r in got} == want and len(got) == len(want)
    assert dictionary.contained_terms(docs, table.where("false"), "id", "text").count() == 0
