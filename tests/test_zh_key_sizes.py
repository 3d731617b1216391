"""The query over all rows leaves its planner the true size of the keys it found."""

from regulith.catalog import load
from regulith.operators import joins


def test_found_keys_of_the_query_are_written_plainly(spark, data_dir, monkeypatch):
    tables, write = {}, joins.materialise
    monkeypatch.setattr(joins, "materialise", lambda df, label, **how: tables.setdefault(label, write(df, label, **how)))
    load()[0]["j10_contained_in_zh_all"](spark, data_dir)
    found = tables["found-keys"]
    assert int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 16 * found.count() > 0
