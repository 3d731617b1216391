"""Rows of a cell inside a sorted partition: the questions first, then the citations they meet.

The module is pickled by value with the tasks that use it, so executors need numpy and pyarrow but no installed copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL = ("_province", "_class", "_asset", "_shard")
SIDE = "_side"  # 0: a question, 1: a citation


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bool, pa.RecordBatch]]:
    """(first run of its cell, of questions, rows): the longest pieces of batches that lie in one cell and on one side."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, dtype=bool)
        for name in (*CELL, SIDE):
            column = batch.column(name)
            change[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for at, end in zip(starts, starts[1:]):
            piece = batch.slice(at, end - at)
            cell = tuple(piece.column(name)[0].as_py() for name in CELL)
            yield cell != last, piece.column(SIDE)[0].as_py() == 0, piece
            last = cell
