"""Hard negatives of embeddings by a secondary-sort shuffle.

Every anchor is scored against every row: a stated query set against the whole table, in blocks. Anchors and rows are dealt
to cells of a bounded number of each, and a cell's matrix product never leaves its task. Cells first send an anchor's best
rows of its own label, then, with the anchor's positives known, for each positive the best rows of other labels that its
window admits; nothing else can be in the result, so at most a few rows a cell and anchor travel.

Both times the pairs are packed into keys of (anchor, descending score, id) that sort as bytes, and
``repartitionAndSortWithinPartitions`` deals them by anchor. An iterator over the sorted keys takes the first pairs of
an anchor as positives, or opens a window at each positive and hands the negatives that follow to the open windows. It
holds one anchor's open windows and no list of pairs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regulith.session import materialise

ANCHORS, ROWS, SLAB = 4096, 4096, 256  # anchors and rows of a cell, anchors scored at a time
PAIR = "anchor bigint, score bigint, kind int, id bigint, row bigint"
TOP = 1 << 63
POSITIVE, NEGATIVE = 0, 1
KEY = ">QQBBQQ"


def pair_key(anchor: int, score: int, kind: int, id_: int | None, row: int) -> bytes:
    """Bytes that sort by anchor, score from high to low, positives first, id (null last) and row."""
    return struct.pack(KEY, anchor, TOP - 1 - score, kind, id_ is None, TOP + (id_ or 0), row)


def read_key(key: bytes) -> tuple[int, int, int, int | None, int]:
    anchor, score, kind, missing, id_, row = struct.unpack(KEY, key)
    return anchor, TOP - 1 - score, kind, None if missing else id_ - TOP, row


def anchor_of(key: bytes) -> int:
    """What keys are dealt by."""
    return (int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33


def sorted_pairs(pairs: DataFrame) -> "RDD":  # noqa: F821
    """Keys of the pairs, those of an anchor together and in order."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = pairs.rdd.map(lambda p: (pair_key(p[0], p[1], p[2], p[3], p[4]), None))
    return keyed.repartitionAndSortWithinPartitions(parts, anchor_of).keys()


def first_pairs(keys: Iterator[bytes], n: int) -> Iterator[tuple]:
    """The first n pairs of each anchor."""
    anchor, left = None, 0
    for key in keys:
        at, score, _, id_, row = read_key(key)
        if at != anchor:
            anchor, left = at, n
        if left:
            left -= 1
            yield at, score, n - left, id_, row


def windows(keys: Iterator[bytes], n: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor, positive row, rank, negative id, positive score, negative score): the first n negatives of each window."""
    anchor, open_windows = None, []
    for key in keys:
        at, score, kind, id_, row = read_key(key)
        if at != anchor:
            anchor, open_windows = at, []
        if kind == POSITIVE:
            open_windows.append([score, row, 0])
            continue
        open_windows = [w for w in open_windows if w[2] < n and low * w[0] <= 100 * score]  # scores only fall from here on
        for window in open_windows:
            if 100 * score <= high * window[0]:
                window[2] += 1
                yield at, window[1], window[2], id_, window[0], score


def prepared(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """Rows that take part, numbered, with relabelled labels and whole-number components; written once."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"), x.alias("x"))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(odd, F.lit(True)))
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("x", lambda c: F.floor(256 * c))
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "id", label.alias("label"), whole.alias("v")), "vectors")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equal width, shorter ones filled with zeros; doubles where sums stay exact in them, else 64-bit integers."""
    column = column.combine_chunks()
    counts = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < counts[:, None]] = flat
    return out


def width_of(*columns: pa.ChunkedArray) -> int:
    return max([1, *(int(np.diff(c.combine_chunks().offsets.to_numpy()).max(initial=0)) for c in columns)])


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products as long as they fit 64 bits."""
    peak = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if peak < 2**52:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


class Cell:
    """Anchors and rows of one cell: the rows in order of id, and the scores of some anchors at a time."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])  # nulls come last
        width = width_of(anchors["v"], rows["v"])
        self.anchors, self.left, self.right = anchors, matrix(anchors["v"], width), matrix(rows["v"], width)
        self.numbers, self.labels = anchors["row"].to_numpy(), anchors["label"].to_numpy()
        self.ids, self.missing = rows["id"].fill_null(0).to_numpy(), rows["id"].is_null().to_numpy()
        self.rows, self.row_labels = rows["row"].to_numpy(), rows["label"].to_numpy()

    def each(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place of an anchor, its scores)."""
        for at in range(0, len(self.left), SLAB):
            yield from enumerate(scores(self.left[at : at + SLAB], self.right), at)

    def pairs(self, found: list[tuple[int, np.ndarray, np.ndarray]], kind: int) -> pa.Table:
        """Pairs of (place of an anchor, places of rows, scores)."""
        n = [len(at) for _, at, _ in found]
        at = np.concatenate([at for _, at, _ in found]) if found else np.zeros(0, np.int64)
        score = np.concatenate([s for _, _, s in found]) if found else np.zeros(0, np.int64)
        anchors = np.repeat(self.numbers[[a for a, _, _ in found]], n) if found else np.zeros(0, np.int64)
        return pa.table({
            "anchor": pa.array(anchors, pa.int64()), "score": pa.array(score, pa.int64()), "kind": pa.array(np.full(len(at), kind), pa.int32()),
            "id": pa.array(self.ids[at], pa.int64(), mask=self.missing[at]), "row": pa.array(self.rows[at], pa.int64())})


def leading(score: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the places ``at``, in order of id, the n of highest score; ties to the first."""
    if len(at) > n:
        s = score[at]
        at = at[s >= np.partition(s, len(s) - n)[len(s) - n]]
        at = at[np.argsort(-score[at], kind="stable")[:n]]
    return at


def cells(anchors: DataFrame, rows: DataFrame, fill) -> DataFrame:
    """Pairs that ``fill(Cell) -> pa.Table`` finds where anchor blocks meet row blocks."""
    n_anchors, n_rows = (max(1, -(-df.count() // most)) for df, most in ((anchors, ANCHORS), (rows, ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = anchors.withColumn("_a", part(n_anchors)).withColumn("_r", every(n_rows))
    right = rows.select("row", "id", "label", "v").withColumn("_r", part(n_rows)).withColumn("_a", every(n_anchors))

    def run(a: pa.Table, r: pa.Table) -> pa.Table:
        if not a.num_rows or not r.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("anchor", pa.int64()), ("score", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("row", pa.int64()))})
        return fill(Cell(a, r))

    return left.groupBy("_a", "_r").cogroup(right.groupBy("_a", "_r")).applyInArrow(run, PAIR)


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor, positive and admitted negative.

    Anchors are rows whose id is divisible by ``every``. Labels of ids divisible by 7 first become (label + 1) % 10 and
    components floor(256 * x). Scores are inner products; higher ones come first, ties by smaller id. Positives of an
    anchor are its first ``positives`` other rows of its label; each takes the first ``negatives`` rows of another label
    whose score is ``low`` to ``high`` per cent of the positive's. Positives without such a row give no row.

    Rows with a null label or vector or with a null or non-finite component take no part. A null id is no anchor; it comes
    after all ids in ties. Rows that repeat an id are rows of their own: each is an anchor, and one may be the other's
    positive. Vectors of different lengths are compared as if the shorter ended in zeros. Scores are exact while they fit 64
    bits. Other columns are not read, so their names cannot clash. An empty table gives no rows.
    """
    spark: SparkSession = vectors.sparkSession
    rows = prepared(vectors, id_col, label_col, vector_col)
    anchors = rows.where(F.col("id") % every == 0).toDF(*rows.columns)  # columns of its own, as both meet in cells

    def own_label(cell: Cell) -> pa.Table:
        found = []
        for a, score in cell.each():
            at = leading(score, np.flatnonzero((cell.row_labels == cell.labels[a]) & (cell.rows != cell.numbers[a])), positives)
            found.append((a, at, score[at]))
        return cell.pairs(found, POSITIVE)

    best = sorted_pairs(cells(anchors, rows, own_label)).mapPartitions(lambda keys: first_pairs(keys, positives))
    best = materialise(spark.createDataFrame(best, "anchor bigint, score bigint, place int, id bigint, row bigint"), "positives")
    limits = best.groupBy("anchor").agg(F.collect_set("score").alias("limits"))  # at most ``positives`` of them

    def in_windows(cell: Cell) -> pa.Table:
        found = []
        wanted = cell.anchors["limits"].to_pylist()
        for a, score in cell.each():
            other = np.flatnonzero(cell.row_labels != cell.labels[a])
            hundred = 100 * score[other]
            held = [leading(score, other[(hundred >= low * p) & (hundred <= high * p)], negatives) for p in wanted[a]]
            at = np.unique(np.concatenate(held))
            found.append((a, at, score[at]))
        return cell.pairs(found, NEGATIVE)

    rivals = cells(anchors.join(limits.withColumnRenamed("anchor", "row"), "row"), rows, in_windows)
    opened = best.select("anchor", "score", F.lit(POSITIVE).alias("kind"), "id", "row")
    mined = sorted_pairs(opened.union(rivals)).mapPartitions(lambda keys: windows(keys, negatives, low, high))
    mined = spark.createDataFrame(mined, "anchor bigint, row bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    names = best.select("anchor", "row", F.col("id").alias("positive_id")).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return mined.join(names, ["anchor", "row"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
