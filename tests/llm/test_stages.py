"""Edge cases of the pipeline's stages: nulls, repeated ids and rows, ties, empty tables, extra columns of clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from regulith.llm import line_templates

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
X = "one two three four five six seven eight nine ten eleven twelve"
Y = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, s, None if t is None else len(t)) for k, t, lang, s in rows], DOCS).repartition(2)


def found(df):
    return sorted((str(r.doc_id), str(r.text), str(r.lang), str(r.source)) for r in df.collect())


def test_near_stage_judges_rows_not_ids(spark, data_dir):
    rows = [(0, X, "en", "a"), (2, X, "en", "a"), (2, Y, "en", "a")]
    assert found(corpus_pipeline.near_dedup(spark, table(spark, rows), data_dir)) == found(table(spark, [rows[0], rows[2]]))


def test_survivor_of_ties(spark, data_dir):
    rows = [(5, X, "fr", "b"), (5, X, "en", "c"), (5, X, "en", "b"), (None, X, "aa", "a"), (7, X, None, "a"), (None, Y, "en", "z"), (None, None, "en", "a"), (None, None, "en", "a"), (9, "", "en", "a"), (8, "", "en", "a")]
    want = [rows[2], rows[5], rows[6], rows[7], rows[8], rows[9]]
    for order in (rows, rows[::-1]):
        assert found(corpus_pipeline.near_dedup(spark, table(spark, order), data_dir)) == found(table(spark, want))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_clashing_names(spark, data_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, table(spark, []), data_dir).count() == 0
    rows = [(k, X if k % 3 else Y + f" {k}", "en", "a") for k in range(9)] + [(None, None, None, None), (4, "", "en", "a")]
    docs = table(spark, rows)
    for extra in ("_row", "_head", "node", "component_id", "score", "_id", "_hash", "_dropped", "found", "bin_id2"):
        docs = docs.withColumn(extra, F.lit("x"))
    out = stage(spark, docs, data_dir)
    assert out.count() >= 1
    if name != "packing":
        assert out.columns == docs.columns


def plain_templates(rows, depth=3, percent=60, least=3):
    """Row by row: leaves, constants, templates, as sets of lines of (id, place)."""
    import re

    leaves = {}
    for key, text, *_ in rows:
        for pos, line in enumerate((text or "").split("\n")):
            tokens = re.sub(r"[0-9]+", "<*>", " ".join(re.split(r"[\x20\x09-\x0d]+", line)).strip(" ")).split(" ")
            if tokens != [""]:
                leaves.setdefault((len(tokens), tuple(tokens[:depth])), []).append((key, pos, tuple(tokens)))
    gone = set()
    for (n, _), lines in leaves.items():
        holders, support, groups = {}, {}, {}
        for key, _, tokens in lines:
            holders.setdefault(tokens, set()).add(key)
        for tokens, keys in holders.items():
            for i in range(depth, n):
                support[i, tokens[i]] = support.get((i, tokens[i]), 0) + min(len(keys), least)
        for key, pos, tokens in lines:
            fixed = tuple((i, tokens[i]) for i in range(depth, n) if support[i, tokens[i]] >= least)
            own = fixed if n > depth and 100 * len(fixed) >= percent * (n - depth) else ("line", tokens)
            groups.setdefault(own, []).append((key, pos))
        docs_of = lambda own: {k for k, _ in groups[own]}
        recurring = {own for own in groups if len(docs_of(own)) >= least}
        merged = {own: list(groups[own]) for own in recurring}
        for own in set(groups) - recurring:  # lacks one constant of a recurring template
            for other in recurring:
                if own[:1] != ("line",) and other[:1] != ("line",) and len(other) == len(own) + 1 and set(own) < set(other):
                    merged[other] += groups[own]
        for members in merged.values():
            first = min({k for k, _ in members}, key=lambda k: (k is None, k))
            gone |= {(k, p) for k, p in members if k != first}
    return gone


def dropped(spark, rows):
    out = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(table(spark, rows)).collect()}
    want = plain_templates(rows)
    for key, text, *_ in rows:
        kept = [x for p, x in enumerate(text.split("\n")) if (key, p) not in want] if text is not None else None
        assert out[key] == (None if kept is None else "\n".join(kept))
    return out


def test_unrelated_lines_that_begin_alike_stay(spark):
    rows = [(k, f"The price of {w}", "en", "a") for k, w in enumerate(["gold rose", "silver fell", "wheat doubled", "bread halved"])]
    assert dropped(spark, rows) == {k: t for k, t, *_ in rows}


def test_variable_fields_do_not_depend_on_unrelated_lines(spark):
    rows = [(k, f"Click here to read post by {w}", "en", "a") for k, w in enumerate(["alice", "bob", "carol", "dave"], 1)]
    assert dropped(spark, rows) == {1: rows[0][1], 2: "", 3: "", 4: ""}
    more = [(0, "Click here to see all new toys", "en", "a"), *rows]
    assert dropped(spark, more) == {0: more[0][1], 1: rows[0][1], 2: "", 3: "", 4: ""}


def test_several_templates_of_a_leaf(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        lines = [f"See also the {a} of {rng.choice('abcdefghij')}{rng.choice('klmnop')} in volume {rng.randrange(99)} {b}" for a, b in (("history", "today"), ("future", "soon"))]
        rows.append((k, "\n".join([*lines, f"See also the {rng.random()} x{k} y{k} z{k} w{k} v{k} u{k}", "own line"][: 2 + k % 3]), "en", "a"))
    out = dropped(spark, rows)
    assert out[0] == rows[0][1] and out[3] == ""


def test_a_line_may_lack_one_constant(spark):
    rows = [(k, f"Page {k} of 9 in {'a' if k == 3 else 'the'} guide", "en", "a") for k in range(1, 6)]
    assert dropped(spark, rows) == {1: rows[0][1], 2: "", 3: "", 4: "", 5: ""}
    rows = [(k, f"Page {k} of 9 in {'a' if k == 1 else 'the'} guide", "en", "a") for k in range(1, 6)]
    assert dropped(spark, rows) == {1: rows[0][1], 2: "", 3: "", 4: "", 5: ""}
