"""Removal of repeated word windows by fixed-block anchors.

Every document is a reference: its non-overlapping blocks of half a window (words 0-24, 25-49, ...) are indexed. Any
window contains one whole block of the document it comes from. Every document also probes the index with each of its
rolling windows of block size. A hit counts if the probe occurs in several documents. Around hits, the full windows that
contain the hit as their first block are compared by (window, document): runs of windows that also start in a smaller
document are the maximal exact repeats to which the hits extend.

Fingerprints have 64 bits; two different windows among n are taken for equal with probability n*n/2^65 at most. Probes
travel with 32 bits within their bucket, where a false hit only costs a comparison.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulith.llm.kernel import U64, rolling_ids, within, word_bounds, word_ids
from regulith.llm.packed import Batch, Request, ask, beaten, bucket_count, expand, first_of, judge_first, marked, pack, read_marks, with_marks

BLOCK, PROBE, WINDOW = 0, 1, 2


class Words:
    """The words of a batch, their probes and windows."""

    def __init__(self, batch: Batch, window: int):
        self.batch, self.window, self.block = batch, window, window // 2
        self.first, self.end, self.edges = word_bounds(batch.data, batch.starts, batch.ends)
        self.words = word_ids(batch.data, self.first, self.end)
        self.text = np.repeat(np.arange(len(batch)), np.diff(self.edges))
        # probes: rolling windows of block size in texts that hold a whole window
        probe = rolling_ids(self.words, self.block)
        ok = within(self.edges, self.block)
        long = np.diff(self.edges) >= window
        ok &= long[self.text[: len(ok)]]
        self.at = np.flatnonzero(ok)
        self.probe = probe[self.at]

    def requests(self) -> tuple[Request, Request, np.ndarray]:
        keys, head, group = first_of(self.probe)
        docs = self.batch.ids[self.text[self.at]]
        several = np.zeros(len(keys), np.uint8)
        several[group[docs != docs[head][group]]] = 1
        place = self.at - self.edges[self.text[self.at]]
        blocks = np.unique(self.probe[place % self.block == 0])
        return Request(BLOCK, blocks, short=True), Request(PROBE, keys, (several,), short=True), group

    def window_request(self, marks: dict, buckets: int):
        """First words of the windows around hits, the request on them and its reader."""
        _, ask_probe, group = self.requests()
        hit = self.at[marked(ask_probe, marks, buckets)[group]]
        near = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(near, np.maximum(hit - self.block + 1, self.edges[self.text[hit]]), 1)
        np.add.at(near, hit + 1, -1)
        ok = within(self.edges, self.window)
        start = np.flatnonzero((np.cumsum(near)[: len(ok)] > 0) & ok)
        keys = rolling_ids(self.words, self.window)[start] if len(start) else np.zeros(0, U64)
        text = self.text[start]
        request, read = beaten(keys, self.batch.ids[text], start - self.edges[text], WINDOW, True)
        return start, request, read

    def removed(self, marks: dict, buckets: int) -> np.ndarray:
        start, _, read = self.window_request(marks, buckets)
        begins = np.zeros(len(self.words), bool)
        begins[start[read(marks, buckets)]] = True
        seen = np.cumsum(begins, dtype=np.int64)
        out = seen > 0
        out[self.window :] = seen[self.window :] > seen[: -self.window]
        return out


def judge_hits(blocks):
    """Marks probes that equal an indexed block and occur in several documents."""
    index = [np.cumsum(expand(b, "u4")[0], dtype=np.uint32) for b in blocks.get(BLOCK, [])]
    if not index:
        return
    known = np.unique(np.concatenate(index))
    seen = np.zeros(len(known), np.int64)
    hits = []
    for block in blocks.get(PROBE, []):
        raw = expand(block, "u4", "u1")
        probe = np.cumsum(raw[0], dtype=np.uint32)
        place = np.minimum(np.searchsorted(known, probe), len(known) - 1)
        number = np.flatnonzero(known[place] == probe)
        np.add.at(seen, place[number], 1 + raw[1][number].astype(np.int64))
        hits.append((number, place[number]))
    for i, (number, place) in enumerate(hits):
        yield PROBE, i, number[seen[place] > 1]


def dedup_windows(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``window`` words which also starts in a document of smaller id.

    Words are runs of anything but [\\x20\\x09-\\x0D]. Returns one row per input row: the id, n_words, n_removed, kept_sha256
    of the kept words joined by one space and, if asked for, kept (that text). Other columns are not read. Null texts have
    no words; a null id ranks after all others and stays null. Rows that repeat an id do not remove each other's words.
    An empty table gives no rows.
    """
    if window < 4 or window % 2:
        raise ValueError("window must be an even number of at least 4 words")
    buckets = bucket_count(docs.sparkSession)
    packed = pack(docs, id_col, text_col)

    def probes(batch, marks):
        return Words(batch, window).requests()[:2]

    def windows(batch, marks):
        return [Words(batch, window).window_request(marks, buckets)[1]]

    def finish(parts):
        for part in parts:
            for payload, rows in zip(part.column("payload"), part.column("marks").to_pylist()):
                words = Words(Batch.load(payload.as_buffer()), window)
                yield result(words, words.removed(read_marks(rows), buckets), keep_text)

    first = ask(packed, probes, judge_hits)
    second = ask(with_marks(packed, first), windows, judge_first(WINDOW, True))
    both = first.union(second).groupBy("batch").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    schema = f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if keep_text else "")
    return with_marks(packed, both).mapInArrow(finish, schema)


def result(words: Words, gone: np.ndarray, keep_text: bool) -> pa.RecordBatch:
    batch = words.batch
    counts = np.append(0, np.cumsum(gone, dtype=np.int64))
    raw = batch.data.tobytes()
    first, end = words.first, words.end
    kept = []
    for a, b in zip(words.edges[:-1], words.edges[1:]):
        cut = ~gone[a:b]
        kept.append(b" ".join([raw[x:y] for x, y in zip(first[a:b][cut].tolist(), end[a:b][cut].tolist())]))
    columns = [
        batch.id_array(), pa.array(np.diff(words.edges)), pa.array(counts[words.edges[1:]] - counts[words.edges[:-1]]),
        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    ]
    names = ["id", "n_words", "n_removed", "kept_sha256"]
    if keep_text:
        columns.append(pa.array([k.decode() for k in kept], pa.string()))
        names.append("kept")
    return pa.RecordBatch.from_arrays(columns, names=names)
