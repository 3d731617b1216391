"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over the text picks triggers: the least hash (leftmost on ties) among the places of every window. The
trigger of a window depends on the window's bytes alone, so equal windows have equal triggers at equal distances. The
windows that share a trigger form a phrase, which carries ``width - 1`` bytes of what follows; so every suffix of a
phrase that can start a match lies inside it, no phrase is a prefix of another suffix class, and suffixes of different
phrases compare within the dictionary. The parse is the sequence of phrases.

* Parse: phrases that occur before, compared by (document, place), are covered whole; only the first occurrence of a
  phrase stays in the dictionary.
* Dictionary: suffixes of two phrases can share a window only if the phrases agree on the core that all their windows
  contain. Phrases whose core belongs to no other phrase are settled. The windows of the rest are brought into order by
  (window, document, place); all but the first of a run of equal windows are covered.

Suffixes are ordered by 64-bit fingerprints of their first ``width`` bytes, which is all of the order that matches of
that width need. Two different windows among n are taken for equal with probability n*n/2^65 at most.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulith.llm.kernel import CHUNK, U64, Spans, byte_values, mix
from regulith.llm.packed import Batch, Request, ask, beaten, bucket_count, expand, first_of, judge_first, marked, pack, read_marks, with_marks

GRAM = 8
CORE, PHRASE, WINDOW = 0, 1, 2
SEVERAL = np.uint64(0xFFFFFFFFFFFFFFFF)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


class Phrases:
    """The phrases of a batch: first window, number of windows, fingerprints of core and phrase."""

    def __init__(self, batch: Batch, width: int):
        self.batch, self.width = batch, width
        self.reach = width * 64 // 100  # trigger places per window
        n = len(batch.data)
        valid = np.zeros(n + 1, np.int8)
        long = batch.ends - batch.starts >= width
        valid[batch.starts[long]] = 1
        valid[batch.ends[long] - width + 1] -= 1
        self.valid = np.cumsum(valid[:n], dtype=np.int8).astype(bool)
        parts = [self.chunk(low, min(n, low + CHUNK)) for low in range(0, n, CHUNK)]
        self.low, self.count, self.core, self.phrase = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64))
        text = np.searchsorted(batch.ends, self.low, side="right")
        self.doc, self.place = batch.ids[text], self.low - batch.starts[text]

    def chunk(self, low: int, high: int) -> tuple[np.ndarray, ...]:
        start = np.flatnonzero(self.valid[low:high])
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
        spans = Spans(byte_values(self.batch.data[low : high + self.width - 1]))
        gram = mix(spans.rolling(GRAM))
        gram &= ~U64((1 << 24) - 1)
        gram |= np.arange(len(gram), dtype=U64)
        # the last window's places end with the text, where its grams still fit
        trigger = (least(gram, self.reach) & U64((1 << 24) - 1)).astype(np.int64)[start]
        new = np.ones(len(start), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(start)))
        a, begin = trigger[first], start[first]
        core = mix(spans(a, a + self.width - self.reach + 1))
        phrase = mix(spans(begin, begin + count - 1 + self.width) + mix((count * 4096 + a - begin).astype(U64)))
        return begin + low, count, core, phrase

    def requests(self) -> tuple[Request, np.ndarray, Request, object]:
        """What is asked of cores and phrases, each phrase's core, and the reader of the answer on phrases."""
        cores, head, group = first_of(self.core)
        same = np.ones(len(cores), bool)
        differ = self.phrase != self.phrase[head][group]
        same[group[differ]] = False
        sign = np.where(same, self.phrase[head] & ~U64(1), SEVERAL)
        ask_core = Request(CORE, cores, (sign,), short=True)
        ask_phrase, read = beaten(self.phrase, self.doc, self.place, PHRASE, False)
        return ask_core, group, ask_phrase, read

    def settled(self, marks: dict, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Which phrases occurred before, and which first ones may share windows with other phrases."""
        ask_core, group, _, read = self.requests()
        local = ask_core.columns[0] == SEVERAL
        shared = (local | marked(ask_core, marks, buckets))[group]
        before = read(marks, buckets)
        return before, shared & ~before

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """First bytes of the windows of chosen phrases."""
        count = self.count[chosen]
        base = np.repeat(self.low[chosen] - np.append(0, np.cumsum(count)[:-1]), count)
        return base + np.arange(int(count.sum()))

    def fingerprints(self, start: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), U64)
        edges = np.searchsorted(start, np.arange(0, len(self.batch.data) + CHUNK, CHUNK))
        for k in range(len(edges) - 1):
            cut = slice(edges[k], edges[k + 1])
            if cut.stop > cut.start:
                low = k * CHUNK
                spans = Spans(byte_values(self.batch.data[low : low + CHUNK + self.width - 1]))
                out[cut] = mix(spans(start[cut] - low, start[cut] - low + self.width))
        return out

    def window_request(self, marks: dict, buckets: int):
        """Starts of the windows still open, the request on them and its reader; and the phrases seen before."""
        before, open_ = self.settled(marks, buckets)
        start = self.windows(open_)
        text = np.searchsorted(self.batch.ends, start, side="right")
        request, read = beaten(self.fingerprints(start), self.batch.ids[text], start - self.batch.starts[text], WINDOW, False)
        return before, start, request, read

    def removed(self, marks: dict, buckets: int) -> np.ndarray:
        """Per byte of the batch, whether a repeated window covers it."""
        before, start, _, read = self.window_request(marks, buckets)
        begins = np.zeros(len(self.batch.data), bool)
        begins[self.windows(before)] = True
        begins[start[read(marks, buckets)]] = True
        seen = np.cumsum(begins, dtype=np.int64)
        out = seen > 0
        out[self.width :] = seen[self.width :] > seen[: -self.width]
        return out


def judge_parse(blocks):
    """Marks cores that go with more than one phrase, and phrases that occur before."""
    yield from judge_first(PHRASE, False)(blocks)
    parts = [expand(b, "u4", "u8") for b in blocks.get(CORE, [])]
    if len(parts) < 2:
        return
    keys = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts])
    signs = np.concatenate([p[1] for p in parts])
    block = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    number = np.concatenate([np.arange(len(p[0])) for p in parts])
    _, head, group = first_of(keys)
    several = np.zeros(len(head), bool)
    several[group[(signs != signs[head][group]) | (signs == SEVERAL)]] = True
    at = np.flatnonzero(several[group])
    for b in np.unique(block[at]):
        yield CORE, int(b), number[at[block[at] == b]]


def dedup_strings(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Remove each byte that lies in a string of ``width`` bytes which also starts earlier in the corpus.

    Earlier is a smaller id, or the same id and a smaller place. Returns one row per input row: the id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked for, kept (the remaining bytes). Other columns
    are not read. Null texts are empty; a null id ranks after all others and stays null. Rows that repeat an id count as
    one document read several times: equal places of them do not remove each other. An empty table gives no rows.
    """
    if width < 32:
        raise ValueError("width must be at least 32 bytes")
    buckets = bucket_count(docs.sparkSession)
    packed = pack(docs, id_col, text_col)

    def parse(batch, marks):
        ask_core, _, ask_phrase, _ = Phrases(batch, width).requests()
        return [ask_core, ask_phrase]

    def suffixes(batch, marks):
        return [Phrases(batch, width).window_request(marks, buckets)[2]]

    def finish(parts):
        for part in parts:
            for payload, rows in zip(part.column("payload"), part.column("marks").to_pylist()):
                batch = Batch.load(payload.as_buffer())
                yield result(batch, Phrases(batch, width).removed(read_marks(rows), buckets), keep_text)

    first = ask(packed, parse, judge_parse)
    second = ask(with_marks(packed, first), suffixes, judge_first(WINDOW, False))
    both = first.union(second).groupBy("batch").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    schema = f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep_text else "")
    return with_marks(packed, both).mapInArrow(finish, schema)


def result(batch: Batch, gone: np.ndarray, keep_text: bool) -> pa.RecordBatch:
    counts = np.append(0, np.cumsum(gone, dtype=np.int64))
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    inner = batch.starts[(batch.starts < len(gone)) & (batch.starts < batch.ends)]
    opens[inner] = gone[inner]
    spans = np.append(0, np.cumsum(opens, dtype=np.int64))
    removed = counts[batch.ends] - counts[batch.starts]
    kept = []
    for a, b, r in zip(batch.starts, batch.ends, removed):
        body = batch.data[a:b]
        kept.append((body[~gone[a:b]] if r else body).tobytes())
    columns = [
        batch.id_array(), pa.array(batch.ends - batch.starts), pa.array(removed), pa.array(spans[batch.ends] - spans[batch.starts]),
        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    ]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if keep_text:
        columns.append(pa.array(kept, pa.binary()))
        names.append("kept")
    return pa.RecordBatch.from_arrays(columns, names=names)
