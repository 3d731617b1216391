"""Embedding input is the whole chunk."""

from regulith.plans.chunking import embed_prepare


def test_long_chunks_are_embedded_whole(spark):
    chunks = spark.createDataFrame([("c", 1, "电" * 20_000 + " end", "x", "y")], "citation_id string, chunk_id int, content string, province string, doc_class string")
    assert embed_prepare(chunks).first().text == "电" * 20_000 + " end"
    assert len(embed_prepare(chunks, max_len=8192).first().text) == 8192
