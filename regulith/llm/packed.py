"""Keys by the hundred million, moved as packed blocks instead of rows.

Operators that compare every position of a corpus would shuffle one row per position. Here a task packs its texts into
batches of some megabytes, and for each batch and bucket of the key space sends one compressed block of sorted distinct
keys. A bucket's task reads its blocks, judges the keys, and answers each block with the numbers of the keys it has
marked; the answers travel back to their batch, which repeats its own deterministic work and looks its keys up.
A key that fills a third of the corpus costs one entry per batch, so hot keys need no salt. The number of buckets
follows spark.sql.shuffle.partitions, as for any shuffle.

Batches are numbered by input partition and order; the input must be deterministic, as scans are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regulith.llm.kernel import U64, long_column, text_buffer

BATCH_BYTES = 4 << 20
ARROW_BYTES = 8 << 20
PIECE_BYTES = 1 << 20  # text that is judged at once where rows stay in place; its arrays take some forty times as much


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes, so that very long texts do not pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in one compressed block."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def expand(block: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block, max_output_size=1 << 31)
    width = sum(np.dtype(k).itemsize for k in kinds)
    n, at, out = len(raw) // width, 0, []
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.frombuffer(raw[at : at + size], k))
        at += size
    return out


def steps(values: np.ndarray) -> np.ndarray:
    """Differences, which compress well in sorted columns."""
    return np.diff(values, prepend=values.dtype.type(0))


class Batch:
    """Some whole texts: ids (null ids largest), the bytes, and where each text starts and ends."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.ids, self.missing, self.data, self.starts, self.ends = ids, missing, data, starts, ends

    def __len__(self) -> int:
        return len(self.ids)

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.missing)

    def dump(self) -> bytes:
        head = np.array([len(self.ids)], np.int64).tobytes()
        body = head + self.ids.tobytes() + self.missing.tobytes() + (self.ends - self.starts).tobytes() + self.data.tobytes()
        return zstandard.ZstdCompressor(level=3).compress(body)

    @staticmethod
    def load(block: bytes) -> Batch:
        raw = zstandard.ZstdDecompressor().decompress(block, max_output_size=(1 << 32))
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids = np.frombuffer(raw, np.int64, n, 8)
        missing = np.frombuffer(raw, bool, n, 8 + 8 * n)
        ends = np.cumsum(np.frombuffer(raw, np.int64, n, 8 + 9 * n))
        return Batch(ids, missing, np.frombuffer(raw, np.uint8, -1, 8 + 17 * n) if len(raw) > 8 + 17 * n else np.zeros(0, np.uint8), ends - np.diff(ends, prepend=0), ends)


def batches(parts: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[Batch]:
    """Texts of (id, text) Arrow batches, dealt anew into batches of about ``limit`` bytes."""
    held: list[tuple] = []
    size = 0

    def flush() -> Batch:
        ids, missing, datas, lengths = (np.concatenate(x) for x in zip(*held))
        ends = np.cumsum(lengths)
        return Batch(ids, missing, datas, ends - lengths, ends)

    for part in parts:
        ids, missing = long_column(part.column(0))
        data, starts, ends = text_buffer(part.column(1))
        at = 0
        while at < len(ids):
            room = max(1, limit - size)
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + room, side="right")))
            piece = slice(at, to)
            if ends[to - 1] - starts[at] == (ends[piece] - starts[piece]).sum():
                body = data[starts[at] : ends[to - 1]]
            else:
                body = np.concatenate([data[a:b] for a, b in zip(starts[piece], ends[piece])])
            held.append((ids[piece], missing[piece], body, ends[piece] - starts[piece]))
            size += len(body)
            at = to
            if size >= limit:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(batch, payload): the whole table in compressed batches, dealt by batch."""
    bounded_batches(docs.sparkSession)

    def run(parts):
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(batches(parts)):
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) | k], pa.int64()), pa.array([batch.dump()], pa.binary())], names=["batch", "payload"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, "batch bigint, payload binary").repartition("batch")


def keep_rows(docs: DataFrame, text_col: str, decide: Callable[[Batch], np.ndarray]) -> DataFrame:
    """The rows, all columns as they are, whose text ``decide`` accepts; no row moves.

    Texts are judged in pieces of at most PIECE_BYTES, or one by one if longer.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(parts):
        for part in parts:
            _, starts, ends = text_buffer(part.column(at))
            low = 0
            while low < part.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, starts[low] + PIECE_BYTES, side="right")))
                piece = part.slice(low, high - low)
                n = piece.num_rows
                yield piece.filter(pa.array(decide(Batch(np.arange(n), np.zeros(n, bool), *text_buffer(piece.column(at)))), pa.bool_()))
                low = high

    return docs.mapInArrow(run, docs.schema)


class Request:
    """Sorted distinct keys of one kind, with columns that go along; ``short`` sends 32 bits of each key."""

    def __init__(self, kind: int, keys: np.ndarray, columns: tuple[np.ndarray, ...] = (), short: bool = False):
        self.kind, self.keys, self.columns, self.short = kind, keys, columns, short

    def blocks(self, buckets: int) -> Iterator[tuple[int, slice, bytes]]:
        place = (self.keys >> U64(20)) * U64(buckets)  # 44 bits of the key, scaled: buckets are ranges of keys
        bucket = (place >> U64(44)).astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(bucket))):
            cut = slice(int(a), int(b))
            sent = ((place[cut] >> U64(12)) & U64(0xFFFFFFFF)).astype(np.uint32) if self.short else self.keys[cut]
            yield int(bucket[a]), cut, squeeze(steps(sent), *(c[cut] for c in self.columns))


def first_of(keys: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the number of the least item of each by ``order``, and each item's place among the keys."""
    if order and not all(len(o) < 2 for o in order):
        by = np.lexsort((*reversed(order), keys))
    else:
        by = np.argsort(keys, kind="stable")
    ordered = keys[by]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.empty(len(keys), np.int64)
    group[by] = np.cumsum(new) - 1
    return ordered[new], by[new], group


def ask(packed: DataFrame, requests: Callable, judge: Callable) -> DataFrame:
    """One round: (batch, marks), marks being an array of (kind, bucket, block of numbers).

    ``requests(batch, marks)`` gives the requests of a batch, ``judge(blocks)`` takes {kind: [blocks]} of one bucket and
    yields (kind, number of the block, marked numbers).
    """
    spark = packed.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with_marks = "marks" in packed.columns

    def send(parts):
        for part in parts:
            batch_ids, payloads = part.column(0), part.column(1)
            for i in range(part.num_rows):
                batch = Batch.load(payloads[i].as_buffer())
                marks = read_marks(part.column(2)[i].as_py()) if with_marks else {}
                rows = [(b, r.kind, block) for r in requests(batch, marks) if len(r.keys) for b, _, block in r.blocks(buckets)]
                if rows:
                    bucket, kind, block = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array([batch_ids[i].as_py()] * len(rows), pa.int64()), pa.array(block, pa.binary())],
                        names=["bucket", "kind", "batch", "block"])

    def settle(bucket, held):
        blocks = {k: [b for _, b in v] for k, v in held.items()}
        rows = [(held[kind][i][0], kind, bucket, squeeze(steps(found.astype(np.uint32)))) for kind, i, found in judge(blocks) if len(found)]
        for low in range(0, len(rows), 4096):
            batch, kind, where, block = zip(*rows[low : low + 4096])
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch, pa.int64()), pa.array(kind, pa.int32()), pa.array(where, pa.int32()), pa.array(block, pa.binary())], names=["batch", "kind", "bucket", "block"])

    def answer(parts):
        at, held = None, {}
        for part in parts:
            for bucket, kind, batch, block in zip(*(c.to_pylist() for c in part.columns)):
                if bucket != at:
                    if held:
                        yield from settle(at, held)
                    at, held = bucket, {}
                held.setdefault(kind, []).append((batch, block))
        if held:
            yield from settle(at, held)

    sent = packed.mapInArrow(send, "bucket int, kind int, batch bigint, block binary")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket", "kind", "batch")
    back = dealt.mapInArrow(answer, "batch bigint, kind int, bucket int, block binary")
    return back.groupBy("batch").agg(F.collect_list(F.struct("kind", "bucket", "block")).alias("marks"))


def with_marks(packed: DataFrame, marks: DataFrame) -> DataFrame:
    """The batches with what was answered, (batch, payload, marks)."""
    return packed.select("batch", "payload").join(marks, "batch", "left")


def read_marks(rows: list[dict] | None) -> dict[tuple[int, int], np.ndarray]:
    return {(r["kind"], r["bucket"]): np.cumsum(expand(r["block"], "u4")[0], dtype=np.int64) for r in rows or []}


def marked(request: Request, marks: dict, buckets: int) -> np.ndarray:
    """Which keys of a request were marked."""
    out = np.zeros(len(request.keys), bool)
    place = (request.keys >> U64(20)) * U64(buckets)
    bucket = (place >> U64(44)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a in edges:
        found = marks.get((request.kind, int(bucket[a])))
        if found is not None:
            out[a + found] = True
    return out


def bucket_count(spark: SparkSession) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def judge_first(kind: int, strict_doc: bool) -> Callable:
    """Marks keys that another block has with a smaller document, or (unless strict_doc) a smaller place in it."""

    def judge(blocks):
        parts = [expand(b, "u8", "i8", "u4") for b in blocks.get(kind, [])]
        if len(parts) < 2:
            return
        keys = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
        docs, places = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        block = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        number = np.concatenate([np.arange(len(p[0])) for p in parts])
        by = np.argsort(keys, kind="stable")
        same = keys[by][1:] == keys[by][:-1]
        again = np.zeros(len(keys), bool)
        again[:-1] |= same
        again[1:] |= same
        at = by[again]
        _, least, group = first_of(keys[at], docs[at], places[at])
        head = at[least][group]
        beaten = docs[at] > docs[head] if strict_doc else (docs[at] > docs[head]) | (docs[at] == docs[head]) & (places[at] > places[head])
        at = at[beaten]
        order = np.lexsort((number[at], block[at]))
        at = at[order]
        for b in np.unique(block[at]):
            yield kind, int(b), number[at[block[at] == b]]

    return judge


def beaten(keys: np.ndarray, docs: np.ndarray, places: np.ndarray, kind: int, strict_doc: bool) -> tuple[Request, Callable]:
    """The request that asks which items are not the first of their key, and how to read the answer per item."""
    distinct, head, group = first_of(keys, docs, places)
    request = Request(kind, distinct, (docs[head], places[head].astype(np.uint32)))

    def read(marks: dict, buckets: int) -> np.ndarray:
        first = head[group]
        local = docs > docs[first]
        if not strict_doc:
            local |= (docs == docs[first]) & (places > places[first])
        return local | marked(request, marks, buckets)[group]

    return request, read
