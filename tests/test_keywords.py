"""Keywords in texts: one pass, the same scores as comparing every word with every keyword."""

import random
import time

from regulith.plans import ontology
from regulith.plans.keyword_kernel import Near, distance
from regulith.sources import ontology_terms as terms

KEYWORDS = list(dict.fromkeys(w.lower() for level in terms.LEVELS.values() for ws in level.values() for w in ws))


def _words(n):
    """Keywords with up to five edits, and words of random letters."""
    rng = random.Random(7)
    for k in range(n):
        w = list(rng.choice(KEYWORDS)) if k % 3 else [rng.choice("abcdeimnorst市场") for _ in range(rng.randint(1, 24))]
        for _ in range(rng.randint(0, 5)):
            at, letter = rng.randrange(len(w) + 1), rng.choice("aeimnrst市")
            w[at : at + rng.randint(0, 1)] = [letter] if rng.random() < 0.6 else []
        if w:
            yield "".join(w)


def test_slices_lose_no_near_keyword():
    for least in (0.5, 0.6, 0.8):
        near = Near(KEYWORDS, least)
        for word in _words(1500):
            lengths = lambda k: len(word) >= len(k) * least and len(word) * least <= len(k)
            plain = {k: s for k in KEYWORDS if k != word and lengths(k) and (s := 1.0 - distance(k, word) / max(len(k), len(word))) >= least}
            assert {k: s for k, s in near({word}).items() if k != word} == plain, word


def test_scores_and_spaces(spark):
    rows = [("a", "Maintenence\u00a0x REPAIR\tplan"), ("b", None), ("c", ""), ("d", "maintenence\u000bturbin"), ("e", "广东maintenance")]
    docs = spark.createDataFrame(rows, "citation_id string, content string")
    got = {r.citation_id: (round(r.m, 9), round(r.w, 9)) for r in ontology.keyword_confidence(docs, {"m": ["maintenance", "repair"], "w": ["turbine"]}, 0.8).collect()}
    one = round((1 - 1 / 11) / 2, 9)
    # Only the white space of \\s parts words: the first text's first word is 'maintenence\u00a0x', three edits of 13 letters.
    assert got == {"a": (0.5, 0.0), "b": (0.0, 0.0), "c": (0.0, 0.0), "d": (one, round(1 - 1 / 7, 9)), "e": (0.5, 0.0)}


def test_many_distinct_words_take_seconds(spark):
    """As many distinct words as a large table has: each is compared with few keywords."""
    texts = spark.range(400).selectExpr("id citation_id", "concat_ws(' ', transform(sequence(1, 1500), i -> substr(md5(concat(id, i)), 1, cast(5 + i % 9 as int)))) content").repartition(4)
    scores = ontology.keyword_confidence(texts, terms.LIFECYCLES, 0.8)
    plan = scores._jdf.queryExecution().executedPlan().toString().lower()
    assert "levenshtein" not in plan and "mapinarrow" in plan
    began = time.time()
    assert scores.count() == 400 and scores.filter("operation > 0").count() == 0
    assert time.time() - began < 60
