"""Layout documents: text segments, blocks, tables, paragraphs, all inside array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regulith.functions.text import normalize_cjk, strip
from regulith.session import bind, col


def join_segments(text: Column, segments: Column, length: Column | None = None) -> Column:
    """Concatenation of the valid [start, end) slices of the text, whose ``length`` may be given: counting it walks the text."""
    n = F.length(text) if length is None else length
    start = lambda s: F.coalesce(s["start_index"], F.lit(0))
    end = lambda s: F.coalesce(s["end_index"], n)
    valid = F.filter(segments, lambda s: (start(s) >= 0) & (start(s) < n) & (start(s) < end(s)) & (end(s) <= n))
    parts = F.transform(valid, lambda s: F.substring(text, start(s) + 1, end(s) - start(s)))
    return F.coalesce(F.array_join(parts, ""), F.lit(""))


def cell_rows(rows: Column, text: Column) -> Column:
    """Rows of layout cells as rows of normalised strings."""
    rows = F.coalesce(rows, F.array().cast("array<struct<cells:array<struct<layout:struct<text_anchor:struct<text_segments:array<struct<start_index:int,end_index:int>>>>>>>>"))
    return F.transform(
        rows,
        lambda r: F.transform(
            F.coalesce(r["cells"], F.array().cast("array<struct<layout:struct<text_anchor:struct<text_segments:array<struct<start_index:int,end_index:int>>>>>>")),
            lambda c: normalize_cjk(join_segments(text, c["layout"]["text_anchor"]["text_segments"])),
        ),
    )


def table_markdown(header_rows: Column, body_rows: Column) -> Column:
    """Markdown of a table with ragged rows padded; NULL for a table without cells."""
    rows = F.concat(header_rows, body_rows)
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(
        F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    head = F.transform(header_rows, line)
    lines = F.when(
        F.size(header_rows) > 0,
        F.concat(F.slice(head, 1, 1), F.array(rule), F.slice(head, 2, F.greatest(F.size(head) - 1, F.lit(0))), F.transform(body_rows, line)),
    ).otherwise(F.transform(body_rows, line))
    return F.when(
        width > 0,
        F.struct(F.array_join(lines, "\n").alias("markdown"), F.lit("").alias("caption"), F.size(rows).alias("row_count"),
                 width.alias("col_count"), F.lit(0.9).alias("confidence")),
    )


def page_tables(pages: Column, text: Column) -> Column:
    """All tables of a document in page order."""
    per_page = F.transform(pages, lambda p: F.transform(p["tables"], lambda t: table_markdown(cell_rows(t["header_rows"], text), cell_rows(t["body_rows"], text))))
    return F.filter(F.flatten(F.filter(per_page, lambda p: p.isNotNull())), lambda t: t.isNotNull())


def table_count(pages: Column) -> Column:
    """How many tables ``page_tables`` gives: those with a cell. No cell is read."""
    held = lambda rows: F.exists(rows, lambda r: F.size(r["cells"]) > 0)
    some = lambda rows: F.coalesce(held(rows), F.lit(False))
    per_page = F.transform(pages, lambda p: F.size(F.filter(p["tables"], lambda t: some(t["header_rows"]) | some(t["body_rows"]))))
    return F.aggregate(F.filter(per_page, lambda n: n > 0), F.lit(0), lambda a, n: a + n)


def block_confidences(pages: Column) -> Column:
    per_page = F.transform(pages, lambda p: F.transform(p["blocks"], lambda b: b["layout"]["confidence"]))
    return F.filter(F.flatten(F.filter(per_page, lambda p: p.isNotNull())), lambda x: x.isNotNull())


def paragraphs(text: Column | str, pages: Column | str | None, min_len: int = 10) -> Column:
    """Blocks where the layout has them, else blank-line paragraphs, else groups of non-empty lines."""
    text = col(text)
    keep = lambda a: F.filter(F.transform(a, normalize_cjk), lambda p: F.length(p) > min_len)
    # Lines are regrouped by marking every white-space-only line as a break.
    lines = F.array_join(F.transform(F.split(text, "\n"), strip), "\n")
    grouped = keep(F.transform(F.split(lines, "\n\n+"), lambda g: F.replace(strip(g), F.lit("\n"), F.lit(" "))))
    fallback = bind(keep(F.split(text, "\n\n")), lambda found: F.when(F.size(found) > 0, found).otherwise(grouped))
    if pages is None:
        return fallback
    per_page = bind(F.length(text), lambda n: F.transform(
        col(pages), lambda p: F.transform(p["blocks"], lambda b: join_segments(text, b["layout"]["text_anchor"]["text_segments"], n))))
    blocks = F.coalesce(keep(F.flatten(F.filter(per_page, lambda p: p.isNotNull()))), F.array().cast("array<string>"))
    return bind(blocks, lambda found: F.when(F.size(found) > 0, found).otherwise(fallback))


def merge_short(paras: Column | str, min_length: int = 50) -> Column:
    """Join a paragraph to the previous one while that one is shorter than ``min_length``."""
    done = F.array().cast("array<string>")
    state = F.aggregate(
        col(paras), F.struct(done.alias("done"), F.lit("").alias("cur")),
        lambda s, p: F.when(
            (F.length(s["cur"]) < min_length) & (F.length(s["cur"]) > 0),
            F.struct(s["done"].alias("done"), F.concat(s["cur"], F.lit("\n"), p).alias("cur")),
        ).otherwise(F.struct(F.when(F.length(s["cur"]) > 0, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]).alias("done"), p.alias("cur"))),
    )
    return bind(state, lambda s: F.when(F.length(s["cur"]) > 0, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]))
