"""Keywords of a vocabulary in texts: contained ones by one automaton, near words by a table of the words met so far.

The module is pickled by value with the tasks that use it. Only the keywords found travel on, and a text only where it is still asked for.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOUND, NEAR = "array<string>", "array<struct<word:string,sim:double>>"
ROWS = 512
MET = 1_000_000  # words remembered by a task, about


def distance(a: str, b: str) -> int:
    """Edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Near:
    """The keywords near a word: those with edit similarity of ``least`` or more.

    A keyword with room for e edits is cut into e + 1 pieces; a word near it holds one of them, the i-th (from 0) at
    most i places away from its place counted from the front and e - i from that counted from the end. So a word is looked up
    by a few of its slices, told by its length, and compared with the keywords that share one. Equal words may be left out: they are contained.
    """

    def __init__(self, keywords: list[str], least: float):
        if least <= 0:
            raise ValueError("least must be above 0")
        self.least = least
        self.slices: dict[int, dict[tuple[int, int], dict[str, list[str]]]] = {}
        for k in keywords:
            m = len(k)
            for n in range(1, int(m / least) + 2):
                edits = int(max(m, n) * (1 - least) + 1e-6)
                if n < m * least or n * least > m or not edits:
                    continue
                at = self.slices.setdefault(n, {})
                for i in range(edits + 1):
                    a, b = i * m // (edits + 1), (i + 1) * m // (edits + 1)
                    for shift in range(max(-i, n - m - edits + i), min(i, n - m + edits - i) + 1):
                        if a + shift >= 0 and b + shift <= n:
                            at.setdefault((a + shift, b + shift), {}).setdefault(k[a:b], []).append(k)
        self.far: set[str] = set()
        self.known: dict[str, list[tuple[str, float]]] = {}

    def of(self, word: str) -> list[tuple[str, float]]:
        alike = {k for (a, b), pieces in self.slices[len(word)].items() for k in pieces.get(word[a:b], ())}
        sims = ((k, 1.0 - distance(k, word) / max(len(word), len(k))) for k in alike)
        return [(k, sim) for k, sim in sims if sim >= self.least]

    def __call__(self, words: set[str]) -> dict[str, float]:
        best: dict[str, float] = {}
        for word in words - self.far:
            if len(word) not in self.slices:
                continue
            if word not in self.known:
                pairs = self.of(word)
                if not pairs:
                    self.far.add(word)
                    continue
                self.known[word] = pairs
            for keyword, sim in self.known[word]:
                best[keyword] = max(sim, best.get(keyword, 0.0))
        if len(self.far) + len(self.known) > MET:
            self.far.clear()
            self.known.clear()
        return best


def search(names: list[str], levels: dict[str, list[tuple[str, str]]], scored: list[str], least: float | None, ask: Callable | None) -> Callable:
    """A task over (names..., text in lower case): for each level its codes in keyword order, the contained and the near keywords, and the text where ``ask(codes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in {*scored, *(w for index in levels.values() for w, _ in index)}:
            automaton.add_word(word, word)
        automaton.make_automaton()
        parts = re.compile(r"[^ \t\n\x0b\f\r]+")  # the white space of Java's \s
        near = Near(list(dict.fromkeys(scored)), least) if least is not None else None
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                codes: dict[str, list] = {name: [] for name in levels}
                contained, close, kept = [], [], []
                for text in batch.column(len(names)):
                    text = text.as_py()
                    found = {word for _, word in automaton.iter(text)} if text else set()
                    own = {name: list(dict.fromkeys(code for word, code in index if word in found)) for name, index in levels.items()}
                    for name, values in own.items():
                        codes[name].append(values)
                    contained.append(sorted(found))
                    sims = near(set(parts.findall(text))) if near and text else {}
                    close.append([{"word": w, "sim": s} for w, s in sorted(sims.items()) if w not in found])
                    kept.append(text if ask is not None and ask(own) else None)
                arrays = [*(batch.column(i) for i in range(len(names))), *(pa.array(v, pa.list_(pa.string())) for v in codes.values()), pa.array(contained, pa.list_(pa.string())),
                          pa.array(close, pa.list_(pa.struct([("word", pa.string()), ("sim", pa.float64())]))), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *levels, "_found", "_near", "_t"])

    return run
