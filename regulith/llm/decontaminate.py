"""Benchmark decontamination by the q-gram lemma.

Texts and items are folded (letters lowered, runs of anything but letters and digits become one space) and compared as
bytes. An item of m bytes matches if some stretch of a text is within k = share * m edits of it. Such a stretch keeps at
least t = m + 1 - q * (k + 1) of the item's q-grams, on diagonals that differ by k at most. So hits are counted per item in
bands of 2 * (k + 1) diagonals that overlap by half; bands with t hits are verified by an alignment kept within the band.

Items come to the tasks in blocks of bounded size; each block is one pass over the documents. For short items k is lowered
until t is positive; items shorter than q bytes have no q-gram and match nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulith.llm.kernel import CHUNK, U64, Spans, byte_values, mix
from regulith.llm.packed import Batch, batches, bounded_batches, keep_rows

GRAM = 10
FILTER_BITS = 21
BLOCK_BYTES = 4 << 20  # of items that one pass carries


def folded(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the batch's texts with case and punctuation folded, and where each text starts and ends."""
    table = np.full(256, 32, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    for low, high, to in (("a", "z", "a"), ("A", "Z", "a"), ("0", "9", "0")):
        n = ord(high) - ord(low) + 1
        table[ord(low) : ord(low) + n] = np.arange(ord(to), ord(to) + n)
    data = table[batch.data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3  # capitals of Latin-1 letters
    data[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    space = data == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    some = batch.starts < batch.ends
    keep[batch.starts[some]] = ~space[batch.starts[some]]
    counts = np.append(0, np.cumsum(keep, dtype=np.int64))
    return data[keep], counts[batch.starts], counts[batch.ends]


class Index:
    """Q-grams of a block of items."""

    def __init__(self, ids: list[int], items: list[bytes], share: float):
        self.ids, self.items = ids, items
        size = np.array([len(x) for x in items], np.int64)
        self.budget = np.minimum((size * share).astype(np.int64), np.maximum(size // GRAM - 1, 0))
        self.least = size + 1 - GRAM * (self.budget + 1)
        keys, item, place = [], [], []
        for i, text in enumerate(items):
            if self.least[i] < 1:
                continue
            values = byte_values(np.frombuffer(text, np.uint8))
            for low in range(0, len(values) - GRAM + 1, CHUNK):
                k = mix(Spans(values[low : low + CHUNK + GRAM - 1]).rolling(GRAM))
                keys.append(k)
                item.append(np.full(len(k), i))
                place.append(np.arange(low, low + len(k)))
        keys, item, place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, U64), (item, np.int64), (place, np.int64)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.append(self.first, len(keys))
        self.item, self.place = item[order], place[order]
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.keys >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the data, item and place in the item of every common q-gram."""
        at, number = [], []
        for low in range(0, len(data) - GRAM + 1, CHUNK):
            k = mix(Spans(byte_values(data[low : low + CHUNK + GRAM - 1])).rolling(GRAM))
            maybe = np.flatnonzero(self.seen[(k >> U64(64 - FILTER_BITS)).astype(np.int64)])
            where = np.minimum(np.searchsorted(self.keys, k[maybe]), len(self.keys) - 1)
            sure = self.keys[where] == k[maybe]
            at.append(maybe[sure] + low)
            number.append(where[sure])
        at, number = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, number))
        count = self.first[number + 1] - self.first[number]
        entry = np.repeat(self.first[number] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(int(count.sum()))
        return np.repeat(at, count), self.item[entry], self.place[entry]


def aligned(item: bytes, text: np.ndarray, low: int, width: int) -> int:
    """Least edits between the item and a stretch of the text, over alignments whose place in the text less their place in
    the item stays in [low, low + width)."""
    m, shift = len(item), np.arange(width)
    n = len(text)
    padded = np.full(width + m, 256, np.int64)  # beyond the text nothing matches
    a, b = max(0, low), min(n, low + width + m)
    if b > a:
        padded[a - low : b - low] = text[a:b]
    out_of_text = (low + shift < 0) | (low + shift > n)
    row = np.where(out_of_text, m + 1, 0)
    for j, byte in enumerate(item):
        here = row + (padded[j : j + width] != byte)
        here[:-1] = np.minimum(here[:-1], row[1:] + 1)
        row = np.minimum.accumulate(here - shift) + shift
    ends = low + m + shift
    row[(ends < 0) | (ends > n)] = m + 1
    return int(row.min())


def leaks(batch: Batch, index: Index) -> list[tuple[int, int, int]]:
    """(text, item, edits) of a batch."""
    if not len(index.keys):
        return []
    data, starts, ends = folded(batch)
    at, item, place = index.hits(data)
    text = np.searchsorted(ends, at, side="right")
    inside = at + GRAM <= ends[text]
    at, item, place, text = at[inside], item[inside], place[inside], text[inside]
    stride = index.budget[item] + 1
    band = (at - starts[text] - place) // stride
    keys = np.stack([np.concatenate([text, text]), np.concatenate([item, item]), np.concatenate([band, band - 1])])
    order = np.lexsort(keys[::-1])
    keys = keys[:, order]
    new = np.ones(keys.shape[1], bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, keys.shape[1]))
    enough = count >= index.least[keys[1, first]]
    best: dict[tuple[int, int], int] = {}
    for t, i, b in zip(*keys[:, first[enough]].tolist()):
        k, whole = int(index.budget[i]), data[starts[t] : ends[t]]
        if best.get((t, i)) == 0:
            continue
        low, width = b * (k + 1), 2 * (k + 1)
        span = whole[max(0, low) : max(0, low + width + len(index.items[i]))].tobytes()
        edits = 0 if index.items[i] in span else aligned(index.items[i], whole, low, width)
        if edits <= k:
            best[t, i] = min(edits, best.get((t, i), edits))
    return [(t, i, e) for (t, i), e in best.items()]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, share: float = 0.08, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Which documents hold which items: (id, item, edits, item_bytes), one row per pair.

    ``edits`` is the least distance found and at most share * item_bytes (lower for short items, see the module). Null texts
    and null items are empty and match nothing; rows that repeat an id or an item give one row per pair of ids, with the
    least edits. Null ids are kept as null. Other columns are not read. Empty tables give no rows.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    out = None
    for index in indexes(benchmark, share, item_col, item_text):
        found = search(slim, index)
        out = found if out is None else out.union(found)
    out = out.groupBy("id", "item").agg(F.min("edits").alias("edits"), F.max("item_bytes").alias("item_bytes"))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "edits", "item_bytes")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.08, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all columns, that hold no item; see ``contaminated``."""
    for index in indexes(benchmark, share, item_col, item_text):
        docs = keep_rows(docs, text_col, clean_with(index))
    return docs


def clean_with(index: Index):
    def clean(batch: Batch) -> np.ndarray:
        out = np.ones(len(batch), bool)
        out[[t for t, _, _ in leaks(batch, index)]] = False
        return out

    return clean


def indexes(benchmark: DataFrame, share: float, item_col: str, item_text: str) -> list[Index]:
    """Indexes of the items, each over about BLOCK_BYTES of them; one at least."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).alias("text")).where("length(text) > 0")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    return [index_of(items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect(), share) for b in range(blocks)]


def index_of(rows: list, share: float) -> Index:
    raw = [r["text"].encode("utf-8") for r in rows]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    joined = Batch(np.arange(len(raw)), np.zeros(len(raw), bool), np.frombuffer(b"".join(raw), np.uint8), ends - np.diff(ends, prepend=0), ends)
    data, low, high = folded(joined)
    return Index([r["item"] for r in rows], [data[a:b].tobytes().strip() for a, b in zip(low, high)], share)


def search(docs: DataFrame, index: Index) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]):
        for batch in batches(parts):
            found = leaks(batch, index)
            if found:
                text, item, edits = zip(*found)
                text = np.array(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.id_array().take(pa.array(text)), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(edits, pa.int64()), pa.array([len(index.items[i]) for i in item], pa.int64())],
                    names=["id", "item", "edits", "item_bytes"])

    return docs.mapInArrow(run, "id bigint, item bigint, edits bigint, item_bytes bigint")
