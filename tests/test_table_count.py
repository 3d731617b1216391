"""Tables are counted from the layout alone, as many as are extracted."""

from pyspark.sql import functions as F

from regulith.functions.layout import page_tables, table_count
from regulith.sources.tables import PAGE


def test_counts_are_those_of_the_tables(spark):
    cell = {"layout": {"text_anchor": {"text_segments": [{"start_index": 0, "end_index": 2}]}}}
    full, bare = {"cells": [cell]}, {"cells": []}
    table = lambda head, body: {"header_rows": head, "body_rows": body}
    tables = [[table([full], [full])], [table(None, [bare, full]), table([bare], [{"cells": None}]), table(None, None), None], [table([None, full], None)], [], None]
    docs = [[{"blocks": [], "tables": t}] for t in tables] + [[{"blocks": None, "tables": t} for t in tables], [None], []]
    rows = spark.createDataFrame([(i, "some text", d) for i, d in enumerate(docs)] + [(99, "x", None)], f"id int, text string, pages array<{PAGE}>")
    got = rows.select("id", table_count(F.col("pages")).alias("n"), F.size(page_tables(F.col("pages"), F.col("text"))).alias("m")).collect()
    assert [r.n for r in got] == [r.m for r in got]
