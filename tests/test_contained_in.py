"""Containment: equal clauses are searched once, and their pairs are made in the last step alone."""

from regulith.operators import joins
from regulith.operators.joins import contained_in


def test_ids_with_several_clauses_and_equal_clauses(spark):
    clauses = spark.createDataFrame([(1, "red sun rose"), (1, "blue"), (2, "red sun rose"), (3, "x"), (4, ""), (5, "b")], "id int, clause string")
    docs = spark.createDataFrame([(10, "a red sun rose up"), (11, "blue\nred sun rose"), (12, "so blue"), (13, None)], "doc int, text string")
    got = [tuple(r) for r in contained_in(clauses, docs, "id", "clause", "doc", "text").collect()]
    assert sorted(got) == [(1, 10), (1, 11), (1, 12), (2, 10), (2, 11), (5, 11), (5, 12)]


def test_pairs_of_equal_clauses_are_not_shuffled(spark):
    clauses = spark.range(2000).selectExpr("id", "'the red sun rose' clause")
    docs = spark.range(2000).selectExpr("id doc", "concat(id, ' the red sun rose ', id) text")
    links = contained_in(clauses, docs, "id", "clause", "doc", "text")
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan.split("Exchange")[0]  # whatever is dealt to other tasks is dealt before the ids are spread out
    assert links.count() == 4_000_000


def test_files_of_keys_and_askers_are_as_large_as_their_rows(spark, monkeypatch):
    """The planner broadcasts by the size of files; keys and ids that repeat took a bit or two each there, but not in the memory of the driver."""
    tables, write = {}, joins.materialise
    monkeypatch.setattr(joins, "materialise", lambda df, label, **how: tables.setdefault(label, write(df, label, **how)))
    text = " ".join(f"w{i}" for i in range(22))
    clauses = spark.range(20).selectExpr("id", f"concat_ws(' ', slice(split('{text}', ' '), cast(id + 1 as int), 5)) clause")
    docs = spark.range(20_000).selectExpr("id doc", f"'{text}' text")
    contained_in(clauses, docs, "id", "clause", "doc", "text")
    of = lambda label: int(str(tables[label]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert tables["found-keys"].count() > 300_000
    assert of("found-keys") >= 16 * tables["found-keys"].count()
    assert of("askers") >= 24 * tables["askers"].count()
