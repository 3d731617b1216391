"""Ranked lexical search with geometric blocks in each posting list.

Texts are scanned once: of each document stay its length and the frequencies of asked terms. From them come the counts,
the weights, and each document's contributions (what a term adds to a score). Documents with the same heaviest terms are
dealt to the same stretch of tasks, so that shards of some thousand documents are alike; documents of a very common
heaviest term spread over tasks by id.

A shard holds a posting list per term. A list that a search enters is clustered: documents, projected to a few random
directions, join the most similar of evenly spaced pivots. Each block keeps its coordinatewise maximum: the largest
contribution of every term among its documents. A search enters its lists from the largest contribution down, stops when
the rest cannot reach the threshold, skips a block only if its maxima over the search's terms sum up to less than the
threshold, and scores the documents of other blocks in full. The threshold is the k-th score so far or, at first, the k-th
largest contribution of any of its terms in the whole table: k documents have at least that score, so nothing is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regulith.llm.kernel import U64, word_bounds, word_ids
from regulith.llm.packed import batches, bounded_batches
from regulith.operators.windows import topk_per_key
from regulith.session import materialise

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # the bytes of letters, digits and all that is not ASCII
ASKED_BYTES = 4 << 20  # text of the items searched in one pass over the documents
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 20
BLOCK, DIRECTIONS, STEP = 32, 16, 8  # documents of a block (on average), dimensions of the projection, blocks scored at a time

_BREAKS = np.ones(256, bool)
_BREAKS[np.frombuffer(bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)), np.uint8)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(text: str | None) -> list[bytes]:
    return [t.lower() for t in TERM.findall((text or "").encode("utf-8", "surrogatepass"))]  # bytes.lower changes A-Z only


class Asked:
    """The items of one pass: their distinct terms, numbered, and the look-up of words among them."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        found = [sorted(set(terms_of(text))) for _, text in items]
        words = sorted({t for terms in found for t in terms})
        number = {t: k for k, t in enumerate(words)}
        self.searches = [np.array([number[t] for t in terms], np.int64) for terms in found]
        raw = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words], dtype=np.int64)
        self.length = np.diff(end, prepend=0)
        keys = word_ids(raw, end - self.length, end, True) if words else np.zeros(0, U64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.raw, self.start = raw, end - self.length

    @classmethod
    def load(cls, state: dict) -> Asked:
        """From ``vars`` of an object: what is broadcast is plain data."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The asked term each word is, or -1: equal fingerprints are confirmed byte by byte."""
        out = np.full(len(first), -1, np.int64)
        if not len(self) or not len(first):
            return out
        ids = word_ids(data, first, end, True)
        place = np.minimum(np.searchsorted(self.keys, ids), len(self) - 1)
        hit = np.flatnonzero(self.keys[place] == ids)
        term = self.order[place[hit]]
        same = self.length[term] == (end - first)[hit]
        hit, term = hit[same], term[same]
        for n in np.unique(self.length[term]):
            of = np.flatnonzero(self.length[term] == n)
            for at in range(0, len(of), max(1, (1 << 22) // int(n))):
                some = of[at : at + max(1, (1 << 22) // int(n))]
                steps = np.arange(n)
                equal = (_LOWER[data[first[hit[some]][:, None] + steps]] == self.raw[self.start[term[some]][:, None] + steps]).all(axis=1)
                out[hit[some[equal]]] = term[some[equal]]
        return out


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def frequencies(docs: DataFrame, asked, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each text with a term: its length in terms and the frequencies of asked ones."""
    bounded_batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Asked.load(asked.value)
        for batch in batches(parts):
            first, end, edges = word_bounds(batch.data, batch.starts, batch.ends, _BREAKS)
            number = of.numbers(batch.data, first, end)
            hit = np.flatnonzero(number >= 0)
            text = np.repeat(np.arange(len(batch)), np.diff(edges))[hit]
            pair, tf = np.unique(text * max(1, len(of)) + number[hit], return_counts=True)
            counts = np.bincount(pair // max(1, len(of)), minlength=len(batch))
            table = pa.RecordBatch.from_arrays(
                [batch.id_array(), pa.array(np.diff(edges), pa.int64()), lists(pair % max(1, len(of)), counts, pa.int32()), lists(tf, counts, pa.int64())],
                names=["doc_id", "n", "terms", "tfs"])
            yield table.filter(pa.array(np.diff(edges) > 0))

    return docs.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`")).mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def contributions(counted: DataFrame, weights, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, terms, parts, lead, second): what each asked term adds to a score, and the two terms that add most."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            terms, counts = flat(batch.column("terms"))
            tf, _ = flat(batch.column("tfs"))
            m = 50 + 50 * batch.column("n").to_numpy() * n_docs // n_terms
            part = weights.value[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, counts)))
            doc = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((terms, -part, doc))
            ends = np.cumsum(counts)
            head = order[np.minimum(ends - counts, len(order) - 1)]
            next_ = order[np.minimum(np.minimum(ends - counts + 1, ends - 1), len(order) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("terms"), lists(part, counts, pa.int64()), pa.array(terms[head], pa.int32()), pa.array(terms[next_], pa.int32())],
                names=["doc_id", "terms", "parts", "lead", "second"])

    schema = "doc_id bigint, terms array<int>, parts array<bigint>, lead int, second int"
    return counted.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs").mapInArrow(run, schema)


def best_per_term(term: np.ndarray, part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest values of each term."""
    order = np.lexsort((-part, term))
    term, part = term[order], part[order]
    place = np.arange(len(term)) - np.searchsorted(term, term)
    return term[place < k], part[place < k]


def floors(parts: DataFrame, k: int) -> DataFrame:
    """(term, floor): the k-th largest contribution of each term that k documents hold."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, part = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches_:
            new_term, new_part = flat(batch.column("terms"))[0], flat(batch.column("parts"))[0]
            term, part = best_per_term(np.append(term, new_term), np.append(part, new_part), k)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(part, pa.int64())], names=["term", "part"])

    some = parts.select("terms", "parts").mapInArrow(run, "term int, part bigint")
    top = topk_per_key(some, ["term"], [F.col("part").desc()], k)
    return top.groupBy("term").agg(F.min("part").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("term", "floor")


class Shard:
    """Some thousand documents: their contributions by document and by term, and the blocks of lists entered so far."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, terms: np.ndarray, parts: np.ndarray, counts: np.ndarray, directions: np.ndarray):
        self.ids, self.missing, self.terms, self.parts = ids, missing, terms, parts
        self.n_terms = len(directions)
        self.starts = np.cumsum(counts) - counts
        self.counts = counts
        doc = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(terms, kind="stable")
        self.listed = doc[order]
        self.edges = np.searchsorted(terms[order], np.arange(self.n_terms + 1))
        self.most = np.zeros(self.n_terms, np.int64)
        held = np.flatnonzero(np.diff(self.edges))
        self.most[held] = np.maximum.reduceat(parts[order], self.edges[held])
        shape = np.add.reduceat(parts[:, None] * directions[terms], self.starts)
        self.shape = shape / np.maximum(np.linalg.norm(shape, axis=1, keepdims=True), 1e-9)
        self.blocked: dict[int, tuple] = {}

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all contributions of some documents, and where each document's begin among them."""
        counts = self.counts[docs]
        begins = np.cumsum(counts) - counts
        return np.repeat(self.starts[docs] - begins, counts) + np.arange(counts.sum()), begins

    def blocks(self, term: int) -> tuple:
        """Documents of a list by block, the first document of each block, and the maxima: begins, terms, values."""
        if term not in self.blocked:
            docs = self.listed[self.edges[term] : self.edges[term + 1]]
            pivots = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // BLOCK)).astype(np.int64)]
            block = np.argmax(self.shape[docs] @ self.shape[pivots].T, axis=1) if len(pivots) > 1 else np.zeros(len(docs), np.int64)
            order = np.argsort(block, kind="stable")
            docs, block = docs[order], block[order]
            first = np.flatnonzero(np.diff(block, prepend=-1))
            block = np.cumsum(np.diff(block, prepend=block[0]) != 0)
            at, _ = self.entries(docs)
            key = np.repeat(block, self.counts[docs]) * self.n_terms + self.terms[at]
            by = np.argsort(key, kind="stable")
            key = key[by]
            heads = np.flatnonzero(np.diff(key, prepend=-1))
            maxima = np.maximum.reduceat(self.parts[at][by], heads)
            begins = np.searchsorted(key[heads] // self.n_terms, np.arange(len(first)))
            self.blocked[term] = docs, np.append(first, len(docs)), begins, key[heads] % self.n_terms, maxima
        return self.blocked[term]

    def search(self, terms: np.ndarray, asked: np.ndarray, best: Best) -> None:
        """Offer ``best`` every document that may belong to it; ``asked`` marks the terms."""
        terms = terms[self.most[terms] > 0]
        terms = terms[np.argsort(-self.most[terms], kind="stable")]
        rest = np.cumsum(self.most[terms][::-1])[::-1]  # the most that lists from here on give
        seen = np.zeros(len(self.ids), bool)
        for term, reach in zip(terms.tolist(), rest.tolist()):
            if reach < best.threshold:
                return
            docs, first, begins, at_terms, maxima = self.blocks(term)
            bound = np.add.reduceat(maxima * asked[at_terms], begins)
            order = np.argsort(-bound, kind="stable")
            for at in range(0, len(order), STEP):
                open_ = order[at : at + STEP]
                open_ = open_[bound[open_] >= best.threshold]
                if not len(open_):
                    break  # the bounds fall
                some = np.concatenate([docs[first[b] : first[b + 1]] for b in open_.tolist()])
                some = some[~seen[some]]
                if len(some):
                    seen[some] = True
                    entries, starts = self.entries(some)
                    best.offer(np.add.reduceat(self.parts[entries] * asked[self.terms[entries]], starts), self.ids[some], self.missing[some])


class Best:
    """The k best documents of one search so far; equal scores by id, null last."""

    def __init__(self, k: int, floor: int):
        self.k, self.threshold = k, max(1, floor)
        self.scores, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        fit = scores >= self.threshold
        if not fit.any():
            return
        scores, ids, missing = np.append(self.scores, scores[fit]), np.append(self.ids, ids[fit]), np.append(self.missing, missing[fit])
        if len(scores) >= self.k:
            order = np.lexsort((ids, missing, -scores))[: self.k]
            scores, ids, missing = scores[order], ids[order], missing[order]
            self.threshold = max(self.threshold, int(scores[-1]))
        self.scores, self.ids, self.missing = scores, ids, missing


def shards(parts: Iterator[pa.RecordBatch], directions: np.ndarray) -> Iterator[Shard]:
    held: list[tuple] = []
    docs = postings = 0

    def build() -> Shard:
        return Shard(*(np.concatenate(x) for x in zip(*held)), directions)

    for batch in parts:
        for at in range(0, batch.num_rows, 512):
            piece = batch.slice(at, 512)
            terms, counts = flat(piece.column("terms"))
            ids = piece.column("doc_id")
            held.append((ids.fill_null(np.iinfo(np.int64).max).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), terms.astype(np.int64), flat(piece.column("parts"))[0], counts))
            docs, postings = docs + len(counts), postings + len(terms)
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield build()
                held, docs, postings = [], 0, 0
    if held:
        yield build()


def searched(parts: DataFrame, asked, low, k: int) -> DataFrame:
    """(search, item_id, doc_id, score): the k best of each search among the documents of each task."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Asked.load(asked.value)
        directions = np.random.default_rng(0).standard_normal((len(of), DIRECTIONS))
        best = [Best(k, int(low.value[terms].max(initial=0))) for terms in of.searches]
        marked = np.zeros(len(of), np.int64)
        for shard in shards(batches_, directions):
            for terms, state in zip(of.searches, best):
                if len(terms) and shard.most[terms].sum() >= state.threshold:
                    marked[terms] = 1
                    shard.search(terms, marked, state)
                    marked[terms] = 0
        for number, (item, state) in enumerate(zip(of.ids, best)):
            n = len(state.scores)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * n, pa.int64()), pa.array([item] * n, pa.int64()), pa.array(state.ids, pa.int64(), mask=state.missing), pa.array(state.scores, pa.int64())],
                names=["search", "item_id", "doc_id", "score"])

    return parts.select("doc_id", "terms", "parts").mapInArrow(run, "search bigint, item_id bigint, doc_id bigint, score bigint")


def passes(items: DataFrame, id_col: str, text_col: str) -> Iterator[Asked]:
    """Items in groups of about ASKED_BYTES of text; one group is in the driver at a time."""
    held, size = [], 0
    for row in items.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`")).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "") + 1
        if size >= ASKED_BYTES:
            yield Asked(held)
            held, size = [], 0
    if held:
        yield Asked(held)


def search_pass(docs: DataFrame, asked: Asked, k: int, id_col: str, text_col: str) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    context = spark.sparkContext
    shared = context.broadcast(vars(asked))
    counted = materialise(frequencies(docs, shared, id_col, text_col), "frequencies")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weights = np.zeros(max(1, len(asked)), np.int64)
    for row in holders.select("term", weight.alias("w")).toLocalIterator():  # at most one row an asked term
        weights[row["term"]] = row["w"]
    parts = materialise(contributions(counted, context.broadcast(weights), n_docs, max(1, n_terms)), "contributions")
    low = np.zeros(max(1, len(asked)), np.int64)
    for row in floors(parts, k).toLocalIterator():
        low[row["term"]] = row["floor"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_docs // (8 * SHARD_DOCS)))
    alike = parts.repartitionByRange(tasks, "lead", "second", "doc_id").sortWithinPartitions("lead", "second", "doc_id")
    return searched(alike, shared, context.broadcast(low), k)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 of each item, equal scores by smaller id.

    Terms are runs of ASCII letters and digits and of all characters outside ASCII, A-Z lower-cased. A term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))); a document adds weight * ((10^9 tf) div (1000 tf + 20 m)) for each term of the
    item it holds, m being 50 + 50 n N div L. N documents have a term, n is the document's number of terms, L all of them.

    Null, empty and term-free texts are not found and do not count; items of that kind find nothing. Repeated rows of
    documents count and are ranked each; repeated items are searched each. Null document ids come last among equal scores;
    an item of null id is searched. Very long texts are scanned whole. Other columns are not read, so their names cannot
    clash. An empty table of either kind gives no rows. Items are searched in groups of ASKED_BYTES of text, each with a
    pass over the documents; asked terms are the only thing broadcast.
    """
    found = [search_pass(docs, asked, k, id_col, text_col).withColumn("group", F.lit(n)) for n, asked in enumerate(passes(items, item_col, item_text_col))]
    if not found:
        found = [docs.sparkSession.createDataFrame([], "search bigint, item_id bigint, doc_id bigint, score bigint, `group` int")]
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    best = topk_per_key(rows, ["group", "search"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k)
    return best.select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")
