"""Limits of the quality rules come from the distances of each language."""

import random

from regulith.llm.quality_rules import quality_rules

SCHEMA = "doc_id bigint, text string, lang string"


def test_texts_without_a_common_word_are_rejected(spark):
    """With a steep, a flat and an unspaced word list, at any length; the other texts stay."""
    rng = random.Random(3)
    steep = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 1) for k in range(3000)]
    han = [chr(0x4E00 + k) for k in range(1500)]
    make = {
        "steep": lambda n: " ".join(rng.choices(steep, weights, k=n)),
        "flat": lambda n: " ".join(rng.choices(steep[:1200], k=n)),
        "zh": lambda n: "， ".join("".join(rng.choices(han, weights[:1500], k=12)) for _ in range(n // 12)),
    }
    strange = {
        "steep": lambda n: " ".join(f"z{rng.random()}".replace("0.", "") for _ in range(n)), "flat": lambda n: " ".join(f"q{rng.randrange(10**9)}" for _ in range(n)),
        "zh": lambda n: "， ".join("".join(chr(0x7000 + rng.randrange(4000)) for _ in range(12)) for _ in range(n // 12)),
    }
    rows, bad = [], set()
    for lang in make:
        for _ in range(150):
            rows.append((len(rows), make[lang](rng.choice([150, 200, 300, 500])), lang))
        for n in (150, 300, 500):
            bad.add(len(rows))
            rows.append((len(rows), strange[lang](n), lang))
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(3), char_limit=1.0).collect()}
    assert all(out[k].js_words is not None for k in out)
    assert {k for k in out if not out[k].base_failed and not out[k].kept} == bad
