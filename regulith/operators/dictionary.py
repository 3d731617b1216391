"""Large dictionaries as tables: terms contained in texts by an automaton, words near terms by keys they share.

Vocabularies of a few hundred terms are folded into plans as literals; these operators take a DataFrame of any number.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulith.functions.scoring import edit_similarity

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_CHARS = 8 << 20  # characters of terms in one automaton; more terms mean more passes over the texts
DELETED_LENGTH = 19  # longest word whose deletions are listed; longer ones are found by pieces


def _blocks(terms: DataFrame) -> Iterator[list[str]]:
    held, size = [], 0
    for (term,) in terms.where("length(term) > 0").select("term").distinct().toLocalIterator():
        held.append(term)
        size += len(term)
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def contained_terms(docs: DataFrame, terms: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, term, position) of every term of ``terms`` (column term) that a text contains; position (from 1) of its first place.

    One scan of the texts for each BLOCK_CHARS of terms: a task builds the automaton of a block once and runs whole texts
    through it. Matching is by character and case, over word borders. Null and empty texts and terms match nothing.
    """
    spark = docs.sparkSession

    def scan(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for term in block.value:
                automaton.add_word(term, term)
            automaton.make_automaton()
            for batch in batches:
                rows, found, places = [], [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    first: dict[str, int] = {}
                    for end, term in automaton.iter(text or ""):
                        first.setdefault(term, end - len(term) + 2)
                    rows += [row] * len(first)
                    found += first.keys()
                    places += first.values()
                    if len(rows) > 100_000 or row == batch.num_rows - 1:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(places, pa.int64())], names=[key, "term", "position"])
                        rows, found, places = [], [], []

        slim = docs.select(key, text_col)
        return slim.mapInArrow(run, f"`{key}` {slim.schema[key].dataType.simpleString()}, term string, position bigint")

    hits = [scan(spark.sparkContext.broadcast(block)) for block in _blocks(terms)]
    if not hits:
        return docs.select(key, F.lit("").alias("term"), F.lit(0).cast("bigint").alias("position")).limit(0)
    out = hits[0]
    for more in hits[1:]:
        out = out.union(more)
    return out


def _deletions(word: Column, least: float) -> Column:
    """The word with up to (1 - least) of its letters left out."""
    edits = F.floor(F.length(word) * F.lit(1 - least) + 1e-9).cast("int")
    shorter = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w))))
    step = lambda held: F.array_distinct(F.concat(held, F.flatten(F.transform(F.filter(held, lambda w: F.length(w) > 0), shorter))))
    most = int(DELETED_LENGTH * (1 - least) + 1e-9)
    keys = F.array(word)
    for n in range(1, most + 1):
        keys = F.when(edits >= n, step(keys)).otherwise(keys)
    return F.when(F.length(word) <= DELETED_LENGTH, keys).otherwise(F.array().cast("array<string>"))


def _pieces(word: Column, least: float, own: bool) -> Column:
    """Keys of long words: a term cut into one piece more than edits it may have; of a word, what may be such a piece.

    The pieces of a term of length n are keyed by n and number; a word looks for those of all lengths it may match, at
    places up to the edits away.
    """
    n0 = F.length(word)
    edits = lambda n: F.floor(F.floor(n / least + 1e-9) * F.lit(1 - least) + 1e-9).cast("int")
    start = lambda n, i: F.floor(i * n / (edits(n) + 1)).cast("int")

    def keys(n, shifts):
        def of(i, shift):
            a, b = start(n, i), start(n, i + 1)
            return F.concat_ws(":", n.cast("string"), i.cast("string"), F.substring(word, a + shift + 1, b - a))
        return F.flatten(F.transform(F.sequence(F.lit(0), edits(n)), lambda i: F.transform(F.filter(shifts, lambda x: start(n, i) + x >= 0), lambda x: of(i, x))))

    if own:
        found = keys(n0, F.array(F.lit(0)))
    else:
        lengths = F.sequence(F.ceil(n0 * least - 1e-9).cast("int"), F.floor(n0 / least + 1e-9).cast("int"))
        found = F.flatten(F.transform(lengths, lambda n: keys(n, F.sequence(-edits(n), edits(n)))))
    return F.when(n0 >= int(least * (DELETED_LENGTH + 1)), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def near_terms(words: DataFrame, terms: DataFrame, least: float = 0.8) -> DataFrame:
    """(word, term, similarity) of all distinct words (column word) and terms (column term) with edit similarity of ``least`` or more.

    Two words that near share a key: what is left of both after leaving out some letters or, for long words, a piece at about
    the same place. Words meet terms by equality of keys; the similarity is computed for these pairs only.
    """
    if not 0.5 <= least <= 1:
        raise ValueError("least must be between 0.5 and 1")
    w = words.where("length(word) > 0").select("word").distinct()
    t = terms.where("length(term) > 0").select("term").distinct()
    own = lambda c, side: F.concat(F.transform(_deletions(F.col(c), least), lambda k: F.concat(F.lit("d"), k)), F.transform(_pieces(F.col(c), least, side), lambda k: F.concat(F.lit("p"), k)))
    pairs = w.select("word", F.explode(own("word", False)).alias("_k")).join(t.select("term", F.explode(own("term", True)).alias("_k")), "_k").select("word", "term").distinct()
    scored = pairs.withColumn("similarity", edit_similarity(F.col("word"), F.col("term")))
    return scored.filter(F.col("similarity") >= least)
