"""Rows that ask for the same clause each get their links."""

from regulith.catalog import load


def test_links_of_equal_clauses_are_kept_for_every_row(spark, data_dir):
    queries, _ = load()
    zh, every = (queries[n](spark, data_dir) for n in ("j10_contained_in_zh", "j10_contained_in_zh_all"))
    assert zh.columns == ["clause_id", "doc_id"]
    assert sorted(zh.collect()) == sorted(every.collect())
