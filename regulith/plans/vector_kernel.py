"""The arithmetic a retrieval task runs on its own Arrow batches.

The module is pickled by value with the tasks that use it, so executors need numpy and pyarrow but
no installed copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from regulith.plans.cell_kernel import runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCOPE = ("province", "doc_class")
DIGITS = 12  # scores are rounded before ranking, so that equal vectors tie on every machine


def unit_rows(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return m / norms


def strings(column) -> np.ndarray:
    return np.array(["" if x is None else x for x in column.to_pylist()], dtype=object)


class TopK:
    """Best k citations of each question of one scope seen so far: score descending, id ascending."""

    def __init__(self, ids, assets, unit, k: int, floor: np.ndarray):
        self.ids, self.assets, self.unit, self.k, self.floor = ids, assets, unit, k, floor.copy()
        self.scores = [np.empty(0)] * len(ids)
        self.names = [np.empty(0, dtype=object)] * len(ids)

    def add(self, names: np.ndarray, assets: np.ndarray, unit: np.ndarray, block: int = 512) -> None:
        for at in range(0, len(self.ids), block):
            sims = np.round(self.unit[at:at + block] @ unit.T, DIGITS)
            fits = sims >= self.floor[at:at + block, None]
            for i in np.flatnonzero(fits.any(axis=1)):  # once k are found, few questions have anything new in a block
                hit = np.flatnonzero(fits[i] & (assets == self.assets[at + i]) if self.assets[at + i] else fits[i])
                if len(hit):
                    self._merge(at + i, sims[i, hit], names[hit])

    def _merge(self, i: int, scores: np.ndarray, names: np.ndarray) -> None:
        scores, names = np.concatenate([self.scores[i], scores]), np.concatenate([self.names[i], names])
        if len(scores) > self.k:
            kth = np.partition(scores, -self.k)[-self.k]
            near = scores >= kth
            scores, names = scores[near], names[near]
            order = np.lexsort((names.astype(str), -scores))[: self.k]
            scores, names = scores[order], names[order]
            self.floor[i] = max(self.floor[i], kth)
        self.scores[i], self.names[i] = scores, names

    def rows(self) -> pa.RecordBatch:
        counts = [len(s) for s in self.scores]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.ids, counts), pa.int64()),
                pa.array(np.concatenate(self.names) if counts else [], pa.string()),
                pa.array(np.concatenate(self.scores) if counts else [], pa.float64()),
            ],
            names=["question_id", "citation_id", "vscore"],
        )


def question_sets(table: pa.Table, k: int, floors: dict[int, float], threshold: float) -> dict:
    """Questions by scope: ids, assets, unit vectors and the score each must reach."""
    if table.num_rows == 0:
        return {}
    province, doc_class, assets = (strings(table[c]) for c in (*SCOPE, "asset"))
    ids, unit = table["question_id"].to_numpy(), unit_rows(table["embedding"])
    out = {}
    for key in sorted(set(zip(province, doc_class))):
        at = np.flatnonzero((province == key[0]) & (doc_class == key[1]))
        floor = np.array([floors.get(int(q), threshold) for q in ids[at]])
        out[key] = (ids[at], assets[at], unit[at], floor)
    return out


POOLS = "question_id bigint, citation_ids array<string>, vscores array<double>"
ASKED, GIVEN = 256, 1024  # questions multiplied at once, questions in a batch of results


class CellTopK:
    """Best k citations of each question of a cell, of citations that come by in the order of their ids: equal scores keep that order."""

    def __init__(self, k: int, low: float, block: int):
        self.k, self.low, self.block = k, low, block
        self.ids, self.units, self.names, self.seen = [], [], [], 0

    def ask(self, piece: pa.RecordBatch) -> None:
        self.ids.append(piece.column("question_id"))
        self.units.append(unit_rows(piece.column("embedding")))

    def add(self, piece: pa.RecordBatch) -> None:
        if not self.ids:
            return
        if not self.names:
            self.unit = np.concatenate(self.units)
            n = len(self.unit)
            self.scores, self.places = np.full((n, self.k), -np.inf), np.zeros((n, self.k), dtype=np.int32)
            self.floor = np.full(n, self.low)
        unit = unit_rows(piece.column("embedding"))
        whole = np.isfinite(unit).all(axis=1)  # others score with nothing
        names, unit = piece.column("citation_id").filter(pa.array(whole)), unit[whole]
        self.names.append(names)
        for at in range(0, len(unit), self.block):
            part = unit[at:at + self.block]
            for first in range(0, len(self.unit), ASKED):
                self._merge(slice(first, first + ASKED), part, self.seen + at)
        self.seen += len(unit)

    def _merge(self, asked: slice, unit: np.ndarray, start: int) -> None:
        sims, floor, k = self.unit[asked] @ unit.T, self.floor[asked], self.k
        near = 2 * 10.0 ** -DIGITS  # rounding moves a score by less
        hits = sims >= (floor - near)[:, None]
        counts = np.count_nonzero(hits, axis=1)
        if counts.max() > 2 * k and sims.shape[1] > k:
            kth = np.partition(sims, -k, axis=1)[:, -k]
            hits = sims >= (np.fmax(floor, kth) - near)[:, None]
            counts = np.count_nonzero(hits, axis=1)
        rows = np.flatnonzero(counts)
        if not len(rows):
            return
        counts = counts[rows]
        row, column = np.nonzero(hits[rows])
        score = np.round(sims[rows[row], column], DIGITS)
        score[score < floor[rows[row]]] = -np.inf
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        new = np.full((len(rows), counts.max()), -np.inf)
        new[row, place] = score
        where = np.zeros(new.shape, dtype=np.int32)
        where[row, place] = start + column
        at = asked.start + rows
        scores, places = np.concatenate([self.scores[at], new], axis=1), np.concatenate([self.places[at], where], axis=1)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        scores = np.take_along_axis(scores, order, axis=1)
        self.scores[at], self.places[at] = scores, np.take_along_axis(places, order, axis=1)
        last = scores[:, -1]
        self.floor[at] = np.where(last > -np.inf, np.maximum(self.low, np.nextafter(last, np.inf)), self.low)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.names:
            return
        ids, names = pa.concat_arrays(self.ids), pa.concat_arrays(self.names)
        for at in range(0, len(ids), GIVEN):
            scores, places = self.scores[at:at + GIVEN], self.places[at:at + GIVEN]
            found = scores > -np.inf
            counts = found.sum(axis=1)
            asked = counts > 0
            offsets = pa.array(np.append(0, np.cumsum(counts[asked])), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, GIVEN).filter(pa.array(asked)), pa.ListArray.from_arrays(offsets, names.take(pa.array(places[found]))),
                 pa.ListArray.from_arrays(offsets, pa.array(scores[found]))],
                names=["question_id", "citation_ids", "vscores"])


def pools_of_cells(k: int, low: float, block: int):
    """The task that gives each question of its cells one row with its k best citations, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        for first, asks, piece in runs(batches):
            if first:
                if cell:
                    yield from cell.rows()
                cell = CellTopK(k, low, block)
            (cell.ask if asks else cell.add)(piece)
        if cell:
            yield from cell.rows()

    return run
