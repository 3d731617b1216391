"""The places of each term of a text, grouped inside the row: no shuffle and no look-up per token.

The module is pickled by value with the tasks that use it, so executors need numpy and pyarrow but no installed copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from regulith.plans.cell_kernel import runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSTINGS = "term string, citation_id string, province string, doc_class string, asset string, length int, positions array<int>"
COUNTS = "citation_id string, length int, terms array<string>, counts array<int>"
SUMS = "question_id bigint, citation_ids array<string>, vscores array<double>, tscores array<double>"
ROWS = 1024
ENTRIES = 1 << 20  # terms of questions looked up at once


def grouped_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(citation_id, province, doc_class, asset, tokens) to a row per citation and distinct token; length leaves out the first token."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            piece = batch.slice(start, ROWS)
            tokens = piece.column("tokens")
            counts = np.diff(tokens.offsets.to_numpy())
            coded = tokens.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            width = max(1, len(coded.dictionary))
            key = row * width + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            heads = np.flatnonzero(np.diff(key, prepend=-1))
            of = pa.array(key[heads] // width)
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(key[heads] % width)), *(piece.column(c).take(of) for c in ("citation_id", "province", "doc_class", "asset")),
                 pa.array((counts - 1)[key[heads] // width], pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.append(heads, len(key)), pa.int32()), pa.array(place, pa.int32()))],
                names=["term", "citation_id", "province", "doc_class", "asset", "length", "positions"])


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(citation_id, tokens) to a row per citation with its distinct tokens and how often it has each."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            piece = batch.slice(start, ROWS)
            tokens = piece.column("tokens")
            lengths = np.diff(tokens.offsets.to_numpy())
            coded = tokens.flatten().dictionary_encode()
            width = max(1, len(coded.dictionary))
            key, counts = np.unique(np.repeat(np.arange(len(lengths)), lengths) * width + coded.indices.to_numpy(), return_counts=True)
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(key // width, minlength=len(lengths)))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [piece.column("citation_id"), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(key % width))),
                 pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))],
                names=["citation_id", "length", "terms", "counts"])


class CellSums:
    """Weights of the terms a question shares with each citation of its pool, summed while the citations of the cell come by."""

    def __init__(self, k1: float):
        self.k1, self.asks, self.ready = k1, [], False

    def ask(self, piece: pa.RecordBatch) -> None:
        self.asks.append(piece.select(["question_id", "citation_ids", "vscores", "terms", "weights"]))

    def _prepare(self) -> None:
        self.table = pa.Table.from_batches(self.asks).combine_chunks()
        column = lambda name: pa.concat_arrays(self.table[name].chunks)
        pools, terms = column("citation_ids"), column("terms")
        self.lengths = np.diff(terms.offsets.to_numpy())
        self.starts = np.cumsum(self.lengths) - self.lengths
        coded = terms.flatten().dictionary_encode()
        self.known, self.codes = coded.dictionary, coded.indices.to_numpy()
        self.weights = np.zeros(len(self.known) + 1)
        self.weights[self.codes] = column("weights").flatten().to_numpy()
        named = pools.flatten().dictionary_encode()
        self.names = named.dictionary
        of = np.repeat(np.arange(len(pools)), np.diff(pools.offsets.to_numpy()))
        name = named.indices.to_numpy()
        self.sums = np.zeros(len(of))
        self.pairs = np.argsort(name, kind="stable")
        self.pairs = self.pairs[self.lengths[of[self.pairs]] > 0]
        self.bounds = np.searchsorted(name[self.pairs], np.arange(len(self.names) + 1))
        self.of = of
        self.ready = True

    def add(self, piece: pa.RecordBatch) -> None:
        if not self.asks:
            return
        if not self.ready:
            self._prepare()
        terms, counts = piece.column("terms"), piece.column("counts").flatten().to_numpy()
        held = np.diff(terms.offsets.to_numpy())
        places = pc.fill_null(pc.index_in(terms.flatten(), value_set=self.known), -1).to_numpy()
        factor = counts * (self.k1 + 1) / (counts + self.k1 * np.repeat(piece.column("norm").to_numpy(), held))
        weight = self.weights[places] * factor
        names = pc.fill_null(pc.index_in(piece.column("citation_id"), value_set=self.names), -1).to_numpy()
        table, ends = np.zeros(len(self.known)), np.cumsum(held)
        for name, end, n in zip(names.tolist(), ends.tolist(), held.tolist()):
            if name < 0:
                continue
            place = places[end - n:end]
            at = np.flatnonzero(place >= 0)
            place = place[at]
            table[place] = weight[end - n:end][at]
            self._sum(self.pairs[self.bounds[name]:self.bounds[name + 1]], table)
            table[place] = 0.0

    def _sum(self, pairs: np.ndarray, table: np.ndarray) -> None:
        """Adds the weights in ``table`` of the terms of each pair's question; a bounded number of terms is laid out at once."""
        if not len(pairs):
            return
        asked = self.of[pairs]
        lengths = self.lengths[asked]
        ends = np.cumsum(lengths)
        if ends[-1] > ENTRIES and len(pairs) > 1:
            half = len(pairs) // 2
            self._sum(pairs[:half], table)
            self._sum(pairs[half:], table)
            return
        begins = ends - lengths
        entry = np.arange(ends[-1]) + np.repeat(self.starts[asked] - begins, lengths)
        self.sums[pairs] += np.add.reduceat(table[self.codes[entry]], begins)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.asks:
            return
        if not self.ready:
            self._prepare()
        offsets = np.append(0, np.cumsum(np.bincount(self.of, minlength=self.table.num_rows)))
        for at in range(0, self.table.num_rows, ROWS):
            part = self.table.slice(at, ROWS)
            first, last = offsets[at], offsets[min(at + ROWS, self.table.num_rows)]
            sums = pa.ListArray.from_arrays(pa.array(offsets[at:at + ROWS + 1] - first, pa.int32()), pa.array(self.sums[first:last]))
            whole = [pa.concat_arrays(part[name].chunks) for name in ("question_id", "citation_ids", "vscores")]
            yield pa.RecordBatch.from_arrays([*whole, sums], names=["question_id", "citation_ids", "vscores", "tscores"])


def sums_of_cells(k1: float):
    """The task that gives each pool of its cells the sums of its pairs, 0 for a pair that shares no term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        for first, asks, piece in runs(batches):
            if first:
                if cell:
                    yield from cell.rows()
                cell = CellSums(k1)
            (cell.ask if asks else cell.add)(piece)
        if cell:
            yield from cell.rows()

    return run
