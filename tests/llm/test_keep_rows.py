"""Rows that stay in place are judged in pieces of bounded size."""

import numpy as np

from regulith.llm.packed import PIECE_BYTES, keep_rows


def test_pieces_are_bounded(spark):
    rows = spark.range(60).selectExpr("id", "case when id % 7 = 3 then null when id % 7 = 4 then '' else repeat(cast(id % 10 as string), 100000) end text").coalesce(1)
    small = lambda batch: np.full(len(batch), len(batch.data) <= PIECE_BYTES)
    assert keep_rows(rows, "text", small).count() == 60
    whole = lambda batch: np.array([b - a == 0 or (batch.data[a] - 48 == batch.data[b - 1] - 48 and b - a == 100000) for a, b in zip(batch.starts, batch.ends)])
    assert sorted(r.id for r in keep_rows(rows, "text", whole).collect()) == list(range(60))


def test_a_text_longer_than_a_piece_is_judged_whole(spark):
    rows = spark.range(3).selectExpr("id", "repeat('a', 1500000) text").coalesce(1)
    assert keep_rows(rows, "text", lambda batch: batch.ends - batch.starts == 1500000).count() == 3
