"""Containment asks for a clause of every row."""

from regulith.catalog import load


def test_every_row_is_asked_for(spark, data_dir, views):
    queries, _ = load()
    asked = {r.clause_id for r in queries["j10_contained_in_zh_all"](spark, data_dir).select("clause_id").distinct().collect()}
    rows = views("citation_zh_v").where("length(content) > 8").select("doc_id").collect()  # a clause begins at character 9 at most
    assert {r.doc_id for r in rows} <= asked
