"""Best-fit packing of documents into training windows, under conflicts.

Documents are dealt into shards by hash, and each shard is packed by itself, largest piece first. A shard keeps its open
bins ordered by residual; each bin carries a bitmap of the sources and one of the duplicate clusters it holds. A piece
goes to the first bin from its own size upwards whose bitmaps have neither its source nor its cluster: the tightest
compatible bin. If there is none it opens a bin.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulith.llm.kernel import mix, word_bounds, word_ids
from regulith.llm.minhash import group_edges, grouped
from regulith.llm.packed import batches, bounded_batches

SHARD = 4096  # documents expected in a shard


def best_fit(pieces: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, source, cluster), placed in the order given; None conflicts with nothing."""
    bit_of: dict = {}
    common = Counter(c for _, _, c in pieces if c is not None)

    def bit(kind: str, value) -> int:
        if value is None or kind == "cluster" and common[value] < 2:
            return 0
        return 1 << bit_of.setdefault((kind, value), len(bit_of))

    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[int] = []  # bitmaps of sources and clusters by bin
    out = []
    for size, source, cluster in pieces:
        mine = bit("source", source) | bit("cluster", cluster)
        at = bisect.bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and held[open_bins[at][1]] & mine:
            at += 1
        if at < len(open_bins):
            residual, number = open_bins.pop(at)
        else:
            residual, number = capacity, len(held)
            held.append(0)
        held[number] |= mine
        out.append((number, capacity - residual))
        if residual > size:
            bisect.insort(open_bins, (residual - size, number))
    return out


def pack_documents(
    docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None,
) -> DataFrame:
    """Bins of at most ``capacity`` words in which no two documents share a source or a duplicate cluster.

    Returns one row per piece: the id, piece (0, 1, ...), n_words, bin_id, bin_offset. A text longer than a bin is cut into full
    pieces, which fill bins of their own, and a rest. Duplicate clusters are texts of equal lower-cased words, or the values
    of ``cluster_col``. Words are runs of anything but [\\x20\\x09-\\x0D]. A text without words, or null, is one piece of 0
    words without a bin. A null source or cluster conflicts with nothing. Rows that repeat an id are packed each. Ties in
    size are placed by id, then by fingerprint. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shards = max(1, math.ceil(docs.select(F.lit(1)).count() / SHARD))
    slim = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"),
        (F.lit(None) if cluster_col is None else F.xxhash64(cluster_col)).cast("bigint").alias("cluster"))

    def measure(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            at = 0
            for batch in batches(iter([part.select([0, 1])])):
                first, end, edges = word_bounds(batch.data, batch.starts, batch.ends)
                words = word_ids(batch.data, first, end, lower=True)
                place = np.arange(len(words)) - np.repeat(edges[:-1], np.diff(edges))
                sums = np.append(np.uint64(0), np.cumsum(mix(words ^ mix(place.astype(np.uint64)))))
                print_ = mix(sums[edges[1:]] - sums[edges[:-1]]).view(np.int64)
                given = part.column(3).slice(at, len(batch))
                own = pa.array(print_) if cluster_col is None else given
                yield pa.RecordBatch.from_arrays(
                    [batch.id_array(), pa.array(np.diff(edges)), part.column(2).slice(at, len(batch)), own, pa.array(print_)], names=["id", "n", "source", "cluster", "sign"])
                at += len(batch)

    def place(parts: Iterator[pa.RecordBatch]):
        for table in grouped(parts, 1):
            edges = group_edges(table, 1)
            for low, high in zip(edges[:-1], edges[1:]):
                yield from shard_rows(table.slice(int(low), int(high - low)), capacity)

    sizes = slim.mapInArrow(measure, "id bigint, n bigint, source string, cluster bigint, sign bigint")
    dealt = sizes.withColumn("shard", F.pmod(F.xxhash64("id", "sign"), F.lit(shards)))
    dealt = dealt.withColumn("rest", F.pmod("n", F.lit(capacity))).select("shard", "id", "n", "source", "cluster", "rest", "sign")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("rest"), "id", "sign")
    out = dealt.mapInArrow(place, "id bigint, piece bigint, n_words bigint, bin_id bigint, bin_offset bigint")
    return out.withColumnRenamed("id", id_col)


def shard_rows(table: pa.Table, capacity: int) -> Iterator[pa.RecordBatch]:
    shard, ids, n, source, cluster = (table.column(k).to_pylist() for k in range(5))
    rest = [(k % capacity, s, c) for k, s, c in zip(n, source, cluster)]
    packed = [i for i, r in enumerate(rest) if r[0]]
    spot = dict(zip(packed, best_fit([rest[i] for i in packed], capacity)))
    number = 1 + max((b for b, _ in spot.values()), default=-1)
    rows = []
    for i, k in enumerate(n):
        base = shard[i] << 32
        for piece in range(k // capacity):
            rows.append((ids[i], piece, capacity, base | number, 0))
            number += 1
            if len(rows) >= 8192:
                yield piece_batch(rows)
                rows = []
        if i in spot:
            rows.append((ids[i], k // capacity, rest[i][0], base | spot[i][0], spot[i][1]))
        elif k == 0:
            rows.append((ids[i], 0, 0, None, None))
    yield piece_batch(rows)


def piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["id", "piece", "n_words", "bin_id", "bin_offset"])
