"""Mixing, ranked search and hard negatives against plain versions, with the edge cases each of them defines."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regulith.llm import lexical, negatives
from regulith.llm.lexical import Asked, Shard, ranked_search
from regulith.llm.mixing import Mix, mix_sources, mixed_text, reversed_bits
from regulith.llm.negatives import hard_negatives, pair_key, read_key

WORD = re.compile(r"[^\x20\x09-\x0d]+")
TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])


def docs_table(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def targets(sizes, weights=(5, 2, 1), percent=150, most=2):
    """Shares by weight; what is above a cap goes to the others, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), percent / 100 * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if most * sizes[s] < weight[s] * level}
        if not above:
            return {s: most * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= above


@pytest.fixture(scope="module")
def mixed_rows():
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    rows = [(k, text(rng.randrange(0, 90)), rng.choice(["a", "a", "a", "a", "b", "c", "é", "z", None])) for k in range(150)]
    rows += [(150, None, "a"), (151, "", "b"), (152, " \n\t ", None), (None, text(30), "c"), (153, text(9000), "a"), (154, text(3), "tiny"), (154, text(3), "tiny"), (155, "", "void")]
    return rows


def test_targets_and_taken_words(spark, mixed_rows):
    out = [r.asDict() for r in mix_sources(docs_table(spark, mixed_rows), block=16).collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in out) == sorted((k is None, k or 0, len(WORD.findall(t or ""))) for k, t, _ in mixed_rows)
    sizes = Counter()
    for _, t, s in mixed_rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    source_of = {k: s for k, _, s in mixed_rows}
    taken = Counter()
    for r in out:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], abs=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = [r.asDict() for r in mix_sources(docs_table(spark, mixed_rows[::-1]), block=16).collect()]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["taken"])
    assert sorted(out, key=key) == sorted(again, key=key)


def test_every_stretch_of_the_mix_is_in_proportion(spark, mixed_rows):
    mix = Mix(docs_table(spark, mixed_rows), block=16)
    rows = mix.schedule.orderBy("slot").collect()
    slots = Counter(r["no"] for r in rows)
    assert len({r["slot"] for r in rows}) == len(rows)
    counted = Counter()
    for i, r in enumerate(rows, 1):
        counted[r["no"]] += 1
        for no, n in slots.items():
            assert abs(counted[no] - i * n / len(rows)) < 2 + math.log2(len(rows))


def test_spans_are_words_of_the_documents(spark, mixed_rows):
    distinct = [r for r in mixed_rows if r[0] not in (None, 154)]
    table = docs_table(spark, distinct)
    mix = Mix(table, block=16)
    texts = {k: WORD.findall(t or "") for k, t, _ in distinct}
    rows = mixed_text(table, mix).collect()
    assert rows
    for r in rows:
        words = r["text"].split(" ")
        assert words == texts[r["doc_id"]][r["start"] : r["start"] + len(words)] and len(words) <= 16
    turns = Counter((r["doc_id"], r["turn"]) for r in rows for _ in r["text"].split(" "))
    assert all(n <= len(texts[k]) for (k, _), n in turns.items())


def test_van_der_corput(spark):
    rows = spark.range(16).select("id", reversed_bits(F.col("id"), 4).alias("r")).collect()
    assert [r["r"] for r in sorted(rows, key=lambda r: r["id"])][:5] == [0, 8, 4, 12, 2] and len({r["r"] for r in rows}) == 16


def test_mixing_of_nothing_and_clashing_names(spark, mixed_rows):
    assert mix_sources(docs_table(spark, [])).count() == 0
    assert {r["taken"] for r in mix_sources(docs_table(spark, [(1, None, "a"), (2, "", None)])).collect()} == {0}
    table = docs_table(spark, mixed_rows)
    for name in ("no", "size", "at", "nth", "digest", "_segment", "block", "slot", "words", "SOURCE_size"):
        table = table.withColumn(name, F.lit("x"))
    assert mix_sources(table).count() == len(mixed_rows)


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=50):
    counts = [(key, Counter(terms(t))) for key, t, *_ in docs]
    counts = [(key, c, sum(c.values())) for key, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for key, c, n in counts:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def searched_rows():
    rng = random.Random(5)
    vocabulary = [f"v{int(rng.paretovariate(0.6)) % 3000}" for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(k, text(rng.randrange(1, 60)), "a") for k in range(700)]
    rows += [(700 + k, "Größe, 中文 ABC-def " + "common " * 40, "b") for k in range(60)]
    rows += [(760, None, "a"), (761, "", "a"), (762, "-- ..", "a"), (None, rows[0][1], "a"), (3, rows[3][1], "a"), (763, text(30000), "a"), (764, "x" * 70000 + " v1", "a")]
    items = [(k, text(12)) for k in range(25)]
    items += [(25, "größe GRÖSSE 中文"), (26, None), (27, ""), (28, "abc ABC def"), (None, text(5)), (2, text(4)), (29, "nowhere"), (30, "X" * 70000), (31, "common v1 v2")]
    return rows, items


def test_search_equals_plain_ranking(spark, searched_rows):
    docs, items = searched_rows
    items_table = spark.createDataFrame(items, "item_id bigint, text string")
    got = ranked_search(docs_table(spark, docs), items_table).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=repr) == plain_search(docs, items)


def test_search_in_small_shards_and_several_passes(spark, searched_rows, monkeypatch):
    docs, items = searched_rows
    for name, value in (("ASKED_BYTES", 200), ("SHARD_DOCS", 64), ("BLOCK", 3), ("STEP", 1)):
        monkeypatch.setattr(lexical, name, value)
    items_table = spark.createDataFrame(items[:9], "item_id bigint, text string").coalesce(1)
    got = ranked_search(docs_table(spark, docs), items_table, k=7).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=repr) == plain_search(docs, items[:9], 7)


def test_blocks_bound_their_documents_and_are_skipped():
    rng = np.random.default_rng(1)
    n, width = 600, 40
    counts = rng.integers(1, 12, n)
    term = np.concatenate([np.sort(rng.choice(width, c, replace=False)) for c in counts])
    part = rng.integers(1, 1000, len(term))
    shard = Shard(np.arange(n), np.zeros(n, bool), term, part, counts, rng.standard_normal((width, 8)))
    for t in range(width):
        docs, first, begins, at_terms, maxima = shard.blocks(t)
        assert sorted(docs) == sorted(shard.listed[shard.edges[t] : shard.edges[t + 1]])
        ends = np.append(begins[1:], len(at_terms))
        for b in range(len(first) - 1):
            most = dict(zip(at_terms[begins[b] : ends[b]], maxima[begins[b] : ends[b]]))
            held, _ = shard.entries(docs[first[b] : first[b + 1]])
            for x, value in zip(shard.terms[held], shard.parts[held]):
                assert value <= most[x]
            assert set(most) == set(shard.terms[held])
    offered = []

    class Counting(lexical.Best):
        def offer(self, scores, ids, missing):
            offered.append(len(ids))
            super().offer(scores, ids, missing)

    asked = np.zeros(width, np.int64)
    asked[[1, 2, 3]] = 1
    best = Counting(3, 0)
    shard.search(np.array([1, 2, 3]), asked, best)
    full = np.add.reduceat(part * asked[term], shard.starts)
    assert sorted(best.scores) == sorted(np.sort(full)[-3:])
    assert sum(offered) < (full > 0).sum()  # some blocks were passed over


def test_equal_fingerprints_are_confirmed():
    asked = Asked([(1, "alpha beta")])
    asked.keys = np.sort(asked.keys)
    data = np.frombuffer(b"Alpha gamma BETA", np.uint8)
    assert asked.numbers(data, np.array([0, 6, 12]), np.array([5, 11, 16])).tolist() == [0, -1, 1]
    asked.raw = np.frombuffer(b"alphXbeta", np.uint8)  # another term under the same fingerprint
    assert asked.numbers(data, np.array([0, 6, 12]), np.array([5, 11, 16])).tolist() == [-1, -1, 1]


def test_search_of_nothing_and_clashing_names(spark, searched_rows):
    docs, items = searched_rows
    items_table = spark.createDataFrame(items, "item_id bigint, text string")
    assert ranked_search(docs_table(spark, []), items_table).count() == 0
    assert ranked_search(docs_table(spark, docs), items_table.where("false")).count() == 0
    table, asked = docs_table(spark, docs[:50]), items_table
    for name in ("n", "terms", "tfs", "score", "rank", "item_id", "search", "group", "lead"):
        table = table.withColumn(name, F.lit("x"))
    for name in ("score", "rank", "doc_id", "terms"):
        asked = asked.withColumn(name, F.lit("x"))
    got = ranked_search(table, asked).collect()
    assert len(got) == len(plain_search(docs[:50], items))


VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain_negatives(rows, every=50):
    kept = []
    for n, (key, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if key is not None and key % 7 == 0 else label
        kept.append((n, key, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for n, key, label, v in kept:
        if key is None or key % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), k is None, k or 0, m, other, k) for m, k, other, w in kept if m != n)
        for p in [s for s in scored if s[4] == label][:5]:
            fit = [s for s in scored if s[4] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:3]
            out += [(key, p[5], rank, s[5], -p[0], -s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(df):
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8) + (k % 3) * 0.2], int(rng.integers(0, 4))) for k in range(400)]
    rows += [(400 + k, [0.5] * 8, k % 3) for k in range(60)]  # ties
    rows += [(500, None, 1), (501, [0.1, None, 0.2], 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] * 8, 2), (504, [0.5] * 8, None), (505, [], 1), (None, [0.5] * 8, 1), (None, [0.4] * 8, 2)]
    rows += [(550, [0.6] * 8, 1), (551, [0.5] * 4, 2), (552, [0.5] * 12, 1), (600, [0.0] * 8, 3), (-50, [-0.4] * 8, 0)]
    return rows


def test_negatives_equal_plain_mining(spark, vectors):
    got = mined(hard_negatives(spark.createDataFrame(vectors, VECTORS).repartition(4)))
    assert got == plain_negatives(vectors) and len(got) > 50


def test_negatives_in_small_cells(spark, vectors, monkeypatch):
    for name, value in (("ANCHORS", 3), ("ROWS", 40), ("SLAB", 2)):
        monkeypatch.setattr(negatives, name, value)
    got = mined(hard_negatives(spark.createDataFrame(vectors, VECTORS).repartition(4)))
    assert got == plain_negatives(vectors)


def test_repeated_vectors_are_rows_of_their_own(spark, vectors):
    rows = vectors[:120] + [vectors[100], vectors[7]]
    assert len(mined(hard_negatives(spark.createDataFrame(rows, VECTORS)))) == len(plain_negatives(rows))


def test_keys_sort_as_pairs():
    rng = random.Random(1)
    pairs = [(rng.randrange(3), rng.randrange(-5, 5), rng.randrange(2), rng.choice([None, -3, 0, 8]), rng.randrange(4)) for _ in range(300)]
    pairs += [(0, 2**63 - 1, 0, 2**63 - 1, 0), (0, -(2**63), 1, -(2**63), 0)]
    order = sorted(pairs, key=lambda p: (p[0], -p[1], p[2], p[3] is None, p[3] or 0, p[4]))
    assert [read_key(k) for k in sorted(pair_key(*p) for p in pairs)] == order


def test_negatives_of_nothing_and_clashing_names(spark, vectors):
    table = spark.createDataFrame(vectors, VECTORS)
    assert hard_negatives(table.where("false")).count() == 0
    for name in ("row", "id", "v", "x", "anchor", "score", "kind", "limits", "_a", "_r"):
        table = table.withColumn(name, F.lit("x"))
    assert mined(hard_negatives(table)) == plain_negatives(vectors)
