"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained with FTRL-proximal.

Features are the distinct words, word pairs and pairs with one or two words between them, hashed into a fixed table; words
are runs of letters and digits with A-Z lowered. Every coordinate has its own learning rate, and the L1 term keeps most
weights at zero, so the model that scoring tasks carry is a short list.

The model is fitted on at most ``max_rows`` labelled rows, drawn by a hash of their id (a documented bound); all rows are
scored over their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulith.llm.kernel import BASE, U64, mix, word_bounds, word_ids
from regulith.llm.packed import PIECE_BYTES, Batch, batches, bounded_batches, expand, keep_rows, squeeze, steps

TABLE_BITS = 20
HALF = 1 << (TABLE_BITS - 1)  # single words are in the lower half of the table, pairs in the upper
SKIPS = (1, 2, 3)  # distance of the second word of a pair
PAIR = 0.3  # value of a pair that is present; a word has 1, so that words are credited first


def breaks() -> np.ndarray:
    out = np.ones(256, bool)
    out[0x80:] = False
    for low, high in (("a", "z"), ("A", "Z"), ("0", "9")):
        out[ord(low) : ord(high) + 1] = False
    return out


def features(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all n-grams and the text of each."""
    first, end, edges = word_bounds(batch.data, batch.starts, batch.ends, breaks())
    words = word_ids(batch.data, first, end, lower=True)
    text = np.repeat(np.arange(len(batch)), np.diff(edges))
    places, owners = [words >> U64(65 - TABLE_BITS)], [text]
    for skip in SKIPS:
        n = max(0, len(words) - skip)
        pair = mix(words[:n] * U64(BASE) + words[skip:] + U64(skip)) >> U64(65 - TABLE_BITS)
        same = text[:n] == text[skip:]
        places.append(pair[same] + U64(HALF))
        owners.append(text[:n][same])
    return np.concatenate(places).astype(np.int64), np.concatenate(owners)


def rows_of(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of each text, text after text, and the first of each."""
    places, owners = features(batch)
    both = np.unique((owners << TABLE_BITS) | places)
    return both & ((1 << TABLE_BITS) - 1), np.searchsorted(both >> TABLE_BITS, np.arange(len(batch) + 1))


class Ftrl:
    """FTRL-proximal over presence features, with a bias that is not penalised."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << TABLE_BITS), np.zeros(1 << TABLE_BITS)
        self.bias_z = self.bias_n = 0.0

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -(z - np.sign(z) * self.l1) * (np.abs(z) > self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        z, n = self.z[at], self.n[at]
        x = np.where(at < HALF, 1.0, PAIR)
        w, b = self.weights(z, n), self.bias()
        error = 1 / (1 + np.exp(-np.clip(w @ x + b, -30, 30))) - label
        g = error * x
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_z += error - ((self.bias_n + error * error) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += error * error


def fit(docs: DataFrame, labels: DataFrame, max_rows: int, epochs: int, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the weights that are not zero, and the bias.

    The training task holds its rows as compressed blocks and opens one at a time.
    """
    bounded_batches(docs.sparkSession)
    own = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label is not null")
    own = own.where(F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(5)) != 0).groupBy("_id").agg(F.max("_label").alias("_label"))
    own = own.withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.join(F.broadcast(own), "_id").select("_order", "_text", "_label")  # at most max_rows rows of three numbers

    def encode(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            at = 0
            for batch in batches(iter([part.select([0, 1])]), PIECE_BYTES):
                places, edges = rows_of(batch)
                blocks = [squeeze(steps(places[a:b].astype(np.uint32))) for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(batch.ids), part.column(2).slice(at, len(batch)), pa.array(blocks, pa.binary())], names=["order", "label", "places"])
                at += len(batch)

    def train(parts: Iterator[pa.RecordBatch]):
        table = [row for part in parts for row in zip(*(part.column(k).to_pylist() for k in range(3)))]
        table.sort(key=lambda r: (r[0], r[2]))
        model = Ftrl()
        for _ in range(epochs):
            for _, label, places in table:
                model.learn(np.cumsum(expand(places, "u4")[0], dtype=np.int64), label)
        w = model.weights(model.z, model.n)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array([at.astype(np.int64).tobytes()], pa.binary()), pa.array([w[at].tobytes()], pa.binary()), pa.array([model.bias() if table else -30.0])], names=["at", "w", "bias"])

    sample = rows.mapInArrow(encode, "order bigint, label int, places binary")
    model = sample.repartition(1).mapInArrow(train, "at binary, w binary, bias double").collect()  # max_rows rows at most
    if not model:
        return np.zeros(0, np.int64), np.zeros(0), -30.0
    return np.frombuffer(model[0]["at"], np.int64), np.frombuffer(model[0]["w"]), model[0]["bias"]


class Scorer:
    """Scores of a batch's texts."""

    def __init__(self, at: np.ndarray, w: np.ndarray, bias: float):
        self.at, self.values, self.bias = at, w * np.where(at < HALF, 1.0, PAIR), bias

    def __call__(self, batch: Batch) -> np.ndarray:
        weights = np.zeros(1 << TABLE_BITS)
        weights[self.at] = self.values
        places, owners = features(batch)
        some = weights[places] != 0
        both = np.unique((owners[some] << TABLE_BITS) | places[some])
        total = self.bias + np.bincount(both >> TABLE_BITS, weights[both & ((1 << TABLE_BITS) - 1)], minlength=len(batch))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, epochs: int = 3,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """Score every text; learn from labelled rows whose crc32(id as text) mod 5 is not 0.

    Returns one row per input row: the id, held_out, score (0 to 1) and predicted (1 from 0.5 on). Only the text enters a
    score. Null texts are empty and get the score of the bias. A null id is held out. Rows that repeat an id are scored
    each; of several labels of an id the largest counts, null labels are ignored. Without any label every score is close
    to 0. Other columns are not read. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    scorer = Scorer(*fit(docs, labels, max_rows, epochs, id_col, text_col, label_col))

    def run(parts: Iterator[pa.RecordBatch]):
        for batch in batches(parts, PIECE_BYTES):
            score = scorer(batch)
            yield pa.RecordBatch.from_arrays([batch.id_array(), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    scored = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, score double, predicted int")
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)) == 0, F.lit(True))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", "predicted")


def reject_toxic(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, epochs: int = 3,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """The rows, with all columns, whose score is below 0.5; see ``score_toxicity``."""
    scorer = Scorer(*fit(docs, labels, max_rows, epochs, id_col, text_col, label_col))
    return keep_rows(docs, text_col, lambda batch: scorer(batch) < 0.5)
