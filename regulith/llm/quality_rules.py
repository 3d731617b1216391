"""Quality rules by distribution divergence.

Each language of the corpus gets two reference histograms, summed over all its documents: classes of characters, and
words (hashed into bins, so that the reference has a fixed size whatever the vocabulary; characters of scripts without
spaces are words of their own). A document that passes the base rules is kept if its own histograms lie near those of its
language in Jensen-Shannon distance. How near is read off the distances of all documents of its language and length: short
texts lie farther off than long ones, and flat word lists farther than steep ones. Documents too short for a histogram to
mean anything are not judged by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regulith.llm.graphs import Scratch
from regulith.llm.kernel import U64, mix, rolling_ids, within, word_bounds, word_ids
from regulith.llm.packed import Batch, batches, bounded_batches, first_of

# The symbols that are counted, and base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5

CLASSES = 9  # lower, upper, digit, space, sentence marks, symbols, other ASCII, two-byte, longer; continuation bytes are skipped
BINS = 1 << 14
LANGUAGES = 128  # references that one pass carries
FENCE, LEAST_SPREAD = 7.0, 0.01  # a limit lies so many times the way from lower quartile to median, of this size at least, above the median
LEAST_DOCS = 20  # of a length, for limits of its own
STEPS = 4  # lengths between a number of words and its double


def byte_classes() -> np.ndarray:
    out = np.full(256, 6, np.int64)
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[[9, 10, 11, 12, 13, 32]] = 3
    out[[ord(c) for c in ".,;:!?'\"()-"]] = 4
    out[[ord(c) for c in SYMBOLS]] = 5
    out[0x80:0xC0] = CLASSES
    out[0xC0:0xE0] = 7
    out[0xE0:] = 8
    return out


def unspaced(data: np.ndarray) -> np.ndarray:
    """First bytes of Han, kana, Thai, Lao, Burmese and Khmer characters, three bytes each."""
    at = np.flatnonzero((data >= 0xE0) & (data <= 0xE9) & (data != 0xE2))
    lead, second = data[at], data[np.minimum(at + 1, max(len(data) - 1, 0))]
    thai = (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB)
    burmese = (lead == 0xE1) & (((second >= 0x80) & (second <= 0x82)) | (second == 0x9E) | (second == 0x9F))
    return at[(lead >= 0xE3) | thai | burmese]


def repeats(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items equal another item of their text, and which equal an earlier one."""
    own = mix(keys ^ mix(text.astype(U64) + U64(1)))
    _, head, group = first_of(own)
    count = np.bincount(group, minlength=len(head))
    later = np.ones(len(keys), bool)
    later[head] = False  # the sort is stable: the head is the first in the text
    return count[group] > 1, later


class Counts:
    """Counts of a batch's texts."""

    def __init__(self, batch: Batch):
        self.batch, n = batch, len(batch)
        data = batch.data
        self.first, self.end, self.edges = word_bounds(data, batch.starts, batch.ends)
        self.text = np.repeat(np.arange(n), np.diff(self.edges))
        self.n_words = np.diff(self.edges)
        self.classes = byte_classes()[data]
        owner = np.repeat(np.arange(n), batch.ends - batch.starts)
        self.histogram = np.bincount(owner * (CLASSES + 1) + self.classes, minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]

    def base(self) -> tuple[np.ndarray, ...]:
        """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
        batch, n = self.batch, len(self.batch)
        points = self.histogram.sum(axis=1)
        chars = points - self.histogram[:, 3]  # the space class is exactly the separators of words
        words = word_ids(batch.data, self.first, self.end)
        at = np.flatnonzero(within(self.edges, REPEAT_WINDOW))
        again, _ = repeats(rolling_ids(words, REPEAT_WINDOW)[at], self.text[at])
        begins = np.zeros(len(words), bool)
        begins[at[again]] = True
        seen = np.cumsum(begins, dtype=np.int64)
        inside = seen > 0
        inside[REPEAT_WINDOW:] = seen[REPEAT_WINDOW:] > seen[:-REPEAT_WINDOW]
        repeated = np.bincount(self.text[inside], minlength=n)
        # lines: between line feeds and text borders, those with a word
        feed = np.flatnonzero(batch.data == 10)
        low = np.unique(np.concatenate([batch.starts[batch.starts < batch.ends], feed + 1]))
        low = low[low < len(batch.data)]
        line_text = np.searchsorted(batch.ends, low, side="right")
        to = np.minimum(np.append(feed, len(batch.data))[np.searchsorted(feed, low)], batch.ends[line_text])
        has = np.searchsorted(self.first, low) < np.searchsorted(self.first, to)
        low, to, line_text = low[has], to[has], line_text[has]
        _, later = repeats(word_ids(batch.data, low, to), line_text)
        return chars, self.histogram[:, 5], np.bincount(line_text[later], minlength=n), repeated

    def bins(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and bin of each word; characters of scripts without spaces are words."""
        data, batch = self.batch.data, self.batch
        at = unspaced(data)
        if not len(at):
            return self.text, (word_ids(data, self.first, self.end, lower=True) >> U64(50)).astype(np.int64)
        code = (data[at].astype(U64) << U64(16)) | (data[at + 1].astype(U64) << U64(8)) | data[at + 2].astype(U64)
        rest = data.copy()
        rest[at[:, None] + np.arange(3)] = 32
        first, end, edges = word_bounds(rest, batch.starts, batch.ends)
        ids = np.concatenate([word_ids(rest, first, end, lower=True), mix(code)])
        text = np.concatenate([np.repeat(np.arange(len(batch)), np.diff(edges)), np.searchsorted(batch.ends, at, side="right")])
        return text, (ids >> U64(50)).astype(np.int64)


def languages(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[Batch, np.ndarray]]:
    """Batches of (id, text, lang) rows with the language of each text, null as empty."""
    for part in parts:
        names = np.array(part.column(2).fill_null("").to_pylist(), object)
        at = 0
        for batch in batches(iter([part.select([0, 1])])):
            yield batch, names[at : at + len(batch)]
            at += len(batch)


def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bin, n): bins below BINS are words, the rest classes of characters."""
    held: dict[str, np.ndarray] = {}

    def flush():
        for lang, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["lang", "bin", "n"])

    for batch, names in languages(parts):
        counts = Counts(batch)
        text, bins = counts.bins()
        for lang in set(names.tolist()):
            mine = names == lang
            total = held.setdefault(lang, np.zeros(BINS + CLASSES, np.int64))
            total[:BINS] += np.bincount(bins[mine[text]], minlength=BINS)
            total[BINS:] += counts.histogram[mine].sum(axis=0)
        if len(held) > 64:
            yield from flush()
            held.clear()
    yield from flush()


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def sparse_divergence(text: np.ndarray, bins: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """The same of the bins of each of n texts from q: bins that a text lacks add q / 2 whatever they are."""
    keys, times = np.unique(text * len(q) + bins, return_counts=True)
    owner, share = keys // len(q), q[keys % len(q)]
    p = times / np.bincount(text, minlength=n)[owner]
    m = (p + share) / 2
    own = p * np.log2(p / m) + np.where(share > 0, share * np.log2(np.where(share > 0, share, 1) / m), 0) - share
    return np.sqrt(np.clip((np.bincount(owner, own, minlength=n) + q.sum()) / 2, 0, 1))


def references(docs: DataFrame) -> DataFrame:
    """(lang, bins, counts): how often each class of characters and each word bin occurs."""
    counts = docs.mapInArrow(sums, "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    return counts.groupBy("lang").agg(F.collect_list(F.struct(F.col("bin").cast("int").alias("bin"), "n")).alias("counts"))  # at most BINS + CLASSES a language


def quality_rules(
    docs: DataFrame, char_limit: float | None = None, word_limit: float | None = None, least_chars: int = 200, least_words: int = 50,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Base counts and the verdict of every document.

    Returns one row per input row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_chars,
    js_words (null where the text has fewer than ``least_chars`` characters in words, ``least_words`` words) and kept: not
    base_failed, and js_chars and js_words at most their limits where they are given. ``char_limit`` and ``word_limit``
    replace the limits of the languages, see ``limits``. Null texts are empty and fail the base rules; rows without
    language share one reference; ids may be null or repeat; other columns are not read. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    known = references(slim)
    rows = known.limit(LANGUAGES + 1).toArrow()
    blocks = 1
    if rows.num_rows > LANGUAGES:  # further passes, each with the references of some languages
        blocks = math.ceil(known.count() / (LANGUAGES // 2))
    out = None
    for b in range(blocks):
        here = F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b
        some = rows if blocks == 1 else known.where(here).toArrow()
        judged = judge(slim if blocks == 1 else slim.where(here), some, least_chars, least_words)
        out = judged if out is None else out.union(judged)
    out, _ = Scratch(docs.sparkSession).keep(out, "distances")
    out = out.join(F.broadcast(limits(out)), ["lang", "length"], "left")  # some sixty lengths a language
    near = lambda js, limit, given: js.isNull() | (js <= (limit if given is None else F.lit(given)))
    kept = ~F.col("base_failed") & near(F.col("js_chars"), F.col("char_limit"), char_limit) & near(F.col("js_words"), F.col("word_limit"), word_limit)
    return out.withColumn("kept", kept).drop("lang", "length", "char_limit", "word_limit").withColumnRenamed("id", id_col)


def limits(distances: DataFrame) -> DataFrame:
    """(lang, length, char_limit, word_limit): far outliers among the distances of a language's documents of one length.

    The spread is taken below the median, where up to half of the documents may be bad without moving it much.
    There are STEPS lengths to each doubling of the words. One with fewer than LEAST_DOCS documents takes the limits of the next shorter one
    that has them, as distances fall with length, or else those of the whole language.
    """
    def fence(name: str) -> Column:
        low, high = (F.get(F.percentile_approx(name, [0.25, 0.5], 1000), k) for k in (0, 1))
        return high + FENCE * F.greatest(high - low, F.lit(LEAST_SPREAD))

    both = [fence("js_chars").alias("c"), fence("js_words").alias("w"), F.count("js_words").alias("n")]
    whole = distances.groupBy("lang").agg(both[0].alias("_c"), both[1].alias("_w"))
    own = distances.groupBy("lang", "length").agg(*both)
    shorter = Window.partitionBy("lang").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(F.when(F.col("n") >= LEAST_DOCS, F.col(c)), ignorenulls=True).over(shorter)
    return own.join(whole, "lang").select("lang", "length", F.coalesce(last("c"), "_c").alias("char_limit"), F.coalesce(last("w"), "_w").alias("word_limit"))


def judge(docs: DataFrame, rows: pa.Table, least_chars: int, least_words: int) -> DataFrame:
    """Base counts and distances, with the language and length of each text."""
    refs = {}
    for lang, counts in zip(rows.column("lang").to_pylist(), rows.column("counts")):
        ref = np.zeros(BINS + CLASSES)
        ref[counts.values.field(0).to_numpy()] = counts.values.field(1).to_numpy()
        refs[lang] = tuple((x / max(1.0, x.sum())).astype(np.float32) for x in (ref[BINS:], ref[:BINS]))

    nothing = (np.zeros(CLASSES, np.float32), np.zeros(BINS, np.float32))

    def run(parts):
        for batch, names in languages(parts):
            counts = Counts(batch)
            chars, symbols, lines, repeated = counts.base()
            (text, bins), n = counts.bins(), len(batch)
            n_bins = np.bincount(text, minlength=n)
            js_chars, js_words = np.zeros(n), np.zeros(n)
            for lang in set(names.tolist()):
                mine = np.flatnonzero(names == lang)
                ref_chars, ref_words = (x.astype(np.float64) for x in refs.get(lang, nothing))  # a language of empty texts has no reference
                p = counts.histogram[mine]
                js_chars[mine] = divergence(p / np.maximum(1, p.sum(axis=1))[:, None], ref_chars)
                number = np.full(n, -1)
                number[mine] = np.arange(len(mine))
                local = number[text]
                at = local >= 0
                js_words[mine] = sparse_divergence(local[at], bins[at], len(mine), ref_words)
            failed = (counts.n_words < LEAST_WORDS) | (100 * repeated > REPEAT_PERCENT * counts.n_words)
            length = (STEPS * np.log2(np.maximum(n_bins, 1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.id_array(), *(pa.array(x.astype(np.int64)) for x in (counts.n_words, chars, symbols, lines, repeated)), pa.array(failed),
                 pa.array(js_chars, mask=chars < least_chars), pa.array(js_words, mask=n_bins < least_words), pa.array(names, pa.string()), pa.array(length)],
                names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words", "lang", "length"])

    return docs.mapInArrow(run, "id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, js_chars double, js_words double, lang string, length int")
