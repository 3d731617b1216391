"""Quality by the perplexity of an interpolated modified Kneser-Ney model trained on trusted text.

The n-grams are runs of ``order`` bytes of the UTF-8 text, packed into one long integer, so contexts and shorter grams are
shifts and masks and every step of the model is a grouping or a join of narrow tables, sharded by gram. Before a text
stand zero bytes, so every byte has a full context.

1. Documents and the ids of trusted ones meet in buckets by id, packed, once.
2. Each bucket lists its distinct grams and counts those of its trusted texts; the sums are the highest order. Lower orders count the different
   bytes in front of a gram. Three discounts per order come from the counts of counts.
3. The probability of each gram in any list is put together from the orders by joins on gram, context and
   suffix.
4. The answers return to the buckets, which score whole texts.
5. Documents above their language's quantile of the perplexities of trusted text that did not train are rejected.

What is gathered, the lists and counts of step 2, comes from every bucket and grows with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulith.llm.graphs import Scratch
from regulith.llm.kernel import mix, text_buffer
from regulith.llm.packed import bounded_batches

TEXTS, TRUSTED = 0, 1
HELD_OUT = 5  # one in so many trusted texts, by hash of the id, does not train and gives the quantiles
BUCKET_BYTES = 16 << 20  # of texts expected in a bucket
HELD_BYTES = 32 << 20  # of texts that a task holds before it sends them to the buckets


def frozen(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def thawed(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(block, max_output_size=1 << 32)).read_all()


def in_buckets(parts: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
    """(bucket, kind, block) of rows whose first column is their bucket."""
    held, size = [], 0

    def flush():
        table = pa.Table.from_batches(held).combine_chunks().sort_by("bucket")
        bucket = table.column(0).to_numpy()
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        for low, high in zip(edges[:-1], edges[1:]):
            block = frozen(table.slice(int(low), int(high - low)).drop_columns(["bucket"]).combine_chunks().to_batches()[0])
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[low])], pa.int64()), pa.array([kind], pa.int32()), pa.array([block], pa.binary())], names=["bucket", "kind", "block"])

    for part in parts:
        if part.num_rows:
            held.append(part)
            size += part.nbytes
        if size >= HELD_BYTES:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


class Grams:
    """All grams of some texts: one per byte, and the text of each."""

    def __init__(self, column: pa.ChunkedArray, order: int):
        data, starts, ends = text_buffer(column)
        lengths = ends - starts
        self.text = np.repeat(np.arange(len(starts)), lengths)
        self.n = lengths
        offset = np.arange(len(self.text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.repeat(starts, lengths) + offset
        self.keys = np.zeros(len(at), np.int64)
        for back in range(order - 1, -1, -1):
            byte = np.where(offset >= back, data[np.maximum(at - back, 0)], 0) if len(at) else np.zeros(0, np.int64)
            self.keys = (self.keys << 8) | byte.astype(np.int64)


def trusted_texts(parts: list[dict]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of a bucket's texts, which of them train the model, and which trusted ones are held out for the quantiles."""
    known = [thawed(p["block"]).column(0).to_numpy() for p in parts if p["kind"] == TRUSTED]
    ids = np.unique(np.concatenate(known)) if known else np.zeros(0, np.int64)
    for p in parts:
        if p["kind"] == TEXTS:
            table = thawed(p["block"])
            own = table.column("id")
            values = own.fill_null(0).to_numpy()
            yes = np.isin(values, ids) & ~own.is_null().to_numpy()
            held = mix(values.astype(np.uint64)) % np.uint64(HELD_OUT) == 0
            yield table, yes & ~held, yes & held


def stretches(table: pa.Table, limit: int = 2 << 20) -> Iterator[tuple[int, pa.Table]]:
    """Rows of a table in runs of bounded text size."""
    size = table.column("text").cast(pa.large_binary()).combine_chunks()
    _, starts, ends = text_buffer(size)
    at = 0
    while at < table.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + limit, side="right")))
        yield at, table.slice(at, to - at)
        at = to


def merged(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*pieces)) if pieces else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    distinct, group = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(group, counts, minlength=len(distinct)).astype(np.int64)


def bucket_grams(parts: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(bucket, g, c): distinct grams of a bucket's texts, and how often each occurs in those that train."""
    for part in parts:
        for bucket, rows in zip(part.column("bucket").to_pylist(), part.column("parts").to_pylist()):
            pieces = []
            for table, yes, _ in trusted_texts(rows):
                for at, some in stretches(table):
                    grams = Grams(some.column("text"), order)
                    number, distinct = pd.factorize(grams.keys)  # by hashing: grams repeat a lot
                    pieces.append((distinct, np.bincount(number, yes[at + grams.text], minlength=len(distinct))))
            keys, counts = merged(pieces)
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["bucket", "g", "c"])


def scores(parts: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for rows, keys, logs in zip(part.column("parts").to_pylist(), part.column("keys"), part.column("logs")):
            keys, logs = (np.asarray(x.values) if x.is_valid else np.zeros(0) for x in (keys, logs))
            place = pd.Index(keys)
            for table, _, held in trusted_texts(rows):
                for at, some in stretches(table):
                    grams = Grams(some.column("text"), order)
                    bits = logs[place.get_indexer(grams.keys)] if len(grams.keys) else np.zeros(0)
                    total = np.bincount(grams.text, bits, minlength=some.num_rows)
                    none = grams.n == 0
                    yield pa.RecordBatch.from_arrays(
                        [some.column("id").combine_chunks(), some.column("lang").combine_chunks(), pa.array(grams.n, pa.int64()),
                         pa.array(np.exp(-total / np.maximum(grams.n, 1)), mask=none), pa.array(held[at : at + some.num_rows])],
                        names=["id", "lang", "n_bytes", "perplexity", "held"])


def suffix(gram: Column, order: int) -> Column:
    """The gram without its first byte."""
    return gram.bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1).cast("bigint"))


def context(gram: Column) -> Column:
    return F.shiftright(gram, 8)


def discounts(counts: DataFrame) -> list[float]:
    """Discounts for counts of one, two, and three or more, from the counts of counts."""
    n = counts.agg(*(F.count(F.when(F.col("c") == k, 1)) for k in (1, 2, 3, 4))).first()
    if not all(n):
        return [0.5, 0.75, 0.9]  # too little text for the estimate
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]  # irregular counts stay in range


def model(counts: DataFrame, order: int, scratch: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """Per order from 1: (g, own) with the discounted share of a gram in its context, and (h, rest) with the mass left to
    the shorter gram."""
    tables = []
    for k in range(order, 0, -1):
        d = discounts(counts)
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = counts.withColumn("h", context(F.col("g"))).groupBy("h").agg(F.sum("c").alias("total"), F.sum(off).alias("off"))
        own = counts.withColumn("h", context(F.col("g"))).join(contexts, "h").select("g", ((F.col("c") - off) / F.col("total")).alias("own"))
        tables.append((own, contexts.select("h", (F.col("off") / F.col("total")).alias("rest"))))
        if k > 1:
            counts, _ = scratch.keep(counts.groupBy(suffix(F.col("g"), k).alias("g")).agg(F.count(F.lit(1)).alias("c")), f"order{k - 1}")
    return tables[::-1]


def probabilities(grams: DataFrame, tables: list[tuple[DataFrame, DataFrame]], order: int) -> DataFrame:
    """(g, logp) of distinct grams: p_k = own_k + rest_k * p_(k-1), with 1/256 below the first order."""
    todo, chain = grams.select("g"), []
    for k in range(order, 0, -1):  # distinct shorter grams first, so that each is put together once
        chain.append(todo)
        todo = todo.select((suffix(F.col("g"), k) if k > 1 else F.lit(0).cast("bigint")).alias("g")).distinct()
    lower = None
    for k in range(1, order + 1):
        own, rest = tables[k - 1]
        rows = chain[order - k].withColumn("h", context(F.col("g"))).join(own, "g", "left").join(rest, "h", "left")
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.withColumn("s", suffix(F.col("g"), k)).join(lower.select(F.col("g").alias("s"), F.col("p").alias("below")), "s")
        lower = rows.select("g", (F.coalesce("own", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("below")).alias("p"))
    return lower.select("g", F.log("p").alias("logp"))


def perplexity_filter(
    docs: DataFrame, labels: DataFrame, order: int = 4, quantile: float = 0.995,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality",
) -> DataFrame:
    """Perplexity per byte of every whole text, and whether it is at most its language's quantile of trusted texts.

    Trusted are documents whose label has quality 1; a fifth of them is held out of the model for the quantiles. Returns one row per input row: the id, n_bytes, perplexity, threshold and
    kept. Null and empty texts have no perplexity and are not kept. A language without trusted text (or null) takes the
    quantile of all trusted text; without any trusted text there is no threshold and texts are kept. Null ids are never
    trusted; rows that repeat an id are scored each. Other columns are not read. An empty table gives no rows. Quantiles
    are those of Spark's mergeable sketch with a rank error of 1/10000.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    key = F.col(id_col).cast("bigint")
    bucket = F.pmod(F.xxhash64(F.coalesce(key, F.xxhash64(text_col))), F.lit(buckets))
    texts = docs.select(bucket.alias("bucket"), key.alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    good = labels.where(F.col(quality_col) == 1).select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), key.alias("id")).where("id is not null")
    schema = "bucket bigint, kind int, block binary"
    dealt = texts.mapInArrow(lambda p: in_buckets(p, TEXTS), schema).union(good.mapInArrow(lambda p: in_buckets(p, TRUSTED), schema))
    dealt = dealt.groupBy("bucket").agg(F.collect_list(F.struct("kind", "block")).alias("parts"))

    wanted, _ = scratch.keep(dealt.mapInArrow(lambda p: bucket_grams(p, order), "bucket bigint, g bigint, c bigint"), "grams")
    counts, _ = scratch.keep(wanted.where("c > 0").groupBy("g").agg(F.sum("c").alias("c")), f"order{order}")
    tables = model(counts, order, scratch)
    logs = probabilities(wanted.select("g").distinct(), tables, order)
    answers = wanted.select("bucket", "g").join(logs, "g").groupBy("bucket").agg(F.collect_list("g").alias("keys"), F.collect_list(F.col("logp").cast("float")).alias("logs"))
    scored = dealt.join(answers, "bucket", "left").mapInArrow(
        lambda p: scores(p, order), "id bigint, lang string, n_bytes bigint, perplexity double, held boolean")
    scored, _ = scratch.keep(scored, "scored")

    sample = scored.where("held and perplexity is not null")
    own = sample.where("lang is not null").groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10000).alias("own"))
    overall = sample.agg(F.percentile_approx("perplexity", quantile, 10000)).first()[0]
    out = scored.join(own, "lang", "left").withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select(F.col("id").alias(id_col), "n_bytes", "perplexity", "threshold", kept.alias("kept"))
