"""Array kernels over batches of texts: words, fingerprints and windows, without a loop per row.

A batch of texts is one byte buffer with a start and an end per text. Fingerprints are polynomials over 64-bit
table values with wrapping arithmetic: prefix sums give any span in two look-ups.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

# The separators of words, [\x20\x09-\x0D].
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 16

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SEPARATORS)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLES: dict[str, np.ndarray] = {}  # filled on first use in each process, so that tasks travel without it


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def table(name: str) -> np.ndarray:
    """Values per byte ("byte", "lower"), powers of the base and of its inverse ("pow", "inv")."""
    if not _TABLES:
        values = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
        lower = values.copy()
        lower[65:91] = values[97:123]
        _TABLES.update(byte=values, lower=lower, pow=_powers(BASE, 2 * CHUNK + 2), inv=_powers(pow(BASE, -1, 1 << 64), 2 * CHUNK + 2))
    return _TABLES[name]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string or binary column with the start and end of each value; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = int(edges[0])
    raw, edges = raw[low : int(edges[-1])], edges - low
    ends = edges[1:].copy()
    if column.null_count:
        missing = column.is_null().to_numpy(zero_copy_only=False)
        ends[missing] = edges[:-1][missing]
    return raw, edges[:-1], ends


def long_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of an id column, null as the largest value, and which are null."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    values = column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    return values, missing


class Spans:
    """Fingerprints of spans inside one stretch of at most 2 * CHUNK values."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * table("pow")[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * table("inv")[start]

    def rolling(self, width: int) -> np.ndarray:
        """Of every window of ``width`` values."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * table("inv")[:n] if n > 0 else np.zeros(0, U64)


def byte_values(data: np.ndarray, lower: bool = False) -> np.ndarray:
    return table("lower" if lower else "byte")[data]


def word_bounds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words and, per text, the number of its first word (with one more entry at the end).

    ``breaks`` tells for each byte value whether it parts words; by default the separators do.
    """
    n = len(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not((_IS_SPACE if breaks is None else breaks)[data], out=inside[:n])
    opens = inside[:n].copy()
    opens[1:] &= ~inside[: n - 1]
    cut = starts[(starts < n) & (starts < ends)]
    opens[cut] = inside[cut]  # a text also starts a word
    closes = inside[:n] & ~inside[1:]
    last = ends[ends > starts] - 1
    closes[last] = inside[last]
    first, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    edges = np.searchsorted(first, np.append(starts, n if not len(ends) else max(int(ends.max()), 0)))
    edges[-1] = len(first)
    return first, end, edges


def word_ids(data: np.ndarray, first: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit fingerprint per word."""
    out = np.empty(len(first), U64)
    at = 0
    while at < len(first):
        low = first[at]
        to = int(np.searchsorted(end, low + CHUNK, side="right"))
        if to <= at:  # one word longer than a chunk
            word = data[low : end[at]].tobytes()
            digest = hashlib.blake2b(word.lower() if lower else word, digest_size=8).digest()
            out[at] = np.frombuffer(digest, U64)[0]
            at += 1
            continue
        spans = Spans(byte_values(data[low : end[to - 1]], lower))
        a, b = first[at:to] - low, end[at:to] - low
        out[at:to] = mix(spans(a, b) + (b - a).astype(U64))
        at = to
    return out


def rolling_ids(values: np.ndarray, width: int) -> np.ndarray:
    """A fingerprint of every run of ``width`` values, across text borders too; callers mask those."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    if width <= 6:
        out = values[:n].copy()
        for k in range(1, width):
            out *= U64(BASE)
            out += values[k : k + n]
        return mix(out)
    out = np.empty(n, U64)
    for low in range(0, n, CHUNK):
        high = min(n, low + CHUNK)
        out[low:high] = Spans(values[low : high + width - 1]).rolling(width)
    return mix(out)


def within(edges: np.ndarray, width: int) -> np.ndarray:
    """Which of the runs that ``rolling_ids`` makes stay inside one text; edges are the texts' first items."""
    total = int(edges[-1]) if len(edges) else 0
    n = max(0, total - width + 1)
    good = np.ones(n, bool)
    for back in range(1, width):  # starts that lie fewer than width items before a border
        at = edges[1:-1] - back
        good[at[(at >= 0) & (at < n)]] = False
    return good


def owner(edges: np.ndarray, n: int | None = None) -> np.ndarray:
    """The text of each item."""
    counts = np.diff(edges)
    out = np.repeat(np.arange(len(counts)), counts)
    return out if n is None else out[:n]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items lie in one of the windows of ``width`` items that begin at ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0
