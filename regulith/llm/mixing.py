"""Mixing sources to target weights by a low-discrepancy schedule of slots.

Targets are shared by weight and stop at a multiple of what a source has. A source needs as many slots as its target has
blocks; slots of all sources side by side are the cumulative weights. The points of van der Corput's sequence in base 2,
0, 1/2, 1/4, 3/4, ..., are mapped through them: the index of the first point that falls on a slot is its place in the mix,
so every stretch of the mix holds the sources nearly in proportion. With 2^m points, at least as many as slots, each slot
is met by one point or two. Slots are ranked within their source, and the k-th slot of a source takes the k-th of its
shuffled blocks.

A source's documents, ordered by a hash, are one stream of words, cut into blocks of equal size. Each pass over the stream
shuffles its blocks anew, the short last one at the end; the last block that a pass takes is cut where the target is met.
Ranks and offsets are running sums over segments, so a source may hold any share of the rows; blocks and slots are made in
pieces of a bounded number of rows. Only the number of slots and the level of the targets reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulith.operators.scans import SEGMENT, positions, running_sums
from regulith.session import materialise

WORDS = "[^\\x20\\x09-\\x0D]+"
PIECE = 1 << 14  # rows that one row is unfolded to at a time


def reversed_bits(x: Column, bits: int) -> Column:
    """The ``bits`` bits of x in reverse order: the index of the point x / 2^bits in van der Corput's sequence."""
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, "0")), 2, 10).cast("bigint") if bits else F.lit(0).cast("bigint")


def unfolded(df: DataFrame, count: Column, name: str, total: int) -> DataFrame:
    """Each row once for each number below ``count``, ``total`` in all, dealt in pieces of PIECE numbers.

    The number of partitions is given, as the pieces' few bytes would have them all put in one.
    """
    last = count - 1
    pieces = df.where(count > 0).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(PIECE).cast("bigint"))))
    dealt = pieces.withColumn("_to", F.least(F.col("_from") + PIECE - 1, last)).repartition(1 + total // (4 * PIECE), "no", "_from")
    return dealt.withColumn(name, F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")


def water_level(sources: DataFrame, total: float) -> float | None:
    """Words per unit of weight such that weights times it, none above its cap, sum up to ``total``; None: all stop at caps."""
    level, before = 0.0, None
    while level != before:
        before = level
        above = F.col("cap") < F.col("weight") * F.lit(before)
        row = sources.agg(F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("fixed"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights")).first()
        if not row["weights"]:
            return None
        level = (total - row["fixed"]) / row["weights"]
    return level


def source_targets(sized: DataFrame, weights: tuple[int, ...], percent: int, most: int, block: int) -> DataFrame:
    """One row per source: no (by code point, null last), source, source_size, target and the counts of its schedule."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = positions(sources, F.col("source").asc_nulls_last(), name="no", label="sources").withColumn("no", F.col("no") - 1)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("no") % len(weights) + 1).cast("int"))
    sources = materialise(sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, percent / 100 * total)
    share = F.col("cap").cast("double")
    if level is not None:
        share = F.when(F.col("cap") < F.col("weight") * F.lit(level), share).otherwise(F.col("weight") * F.lit(level))
    sources = sources.withColumn("target", share).withColumn("words", F.floor(F.col("target") + 0.5))
    blocks = lambda words: F.ceil(words / F.lit(block)).cast("bigint")
    turns = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.greatest(F.lit(0), F.least(F.col("source_size"), F.col("words") - e * F.col("source_size"))))
    sources = sources.withColumn("turns", turns)  # words that each pass over the source takes
    sources = sources.withColumn("slots", F.aggregate("turns", F.lit(0).cast("bigint"), lambda total, words: total + blocks(words)))
    return sources.withColumn("blocks", blocks(F.col("source_size"))).withColumn(SEGMENT, F.expr(f"no div {PIECE}"))


def slots(sources: DataFrame, total: int) -> DataFrame:
    """(no, rank, slot): the k-th slot of each source and its place in the mix."""
    bits = max(0, total - 1).bit_length()
    places = running_sums(sources, [], [F.col("no")], {"first": F.col("slots")}).select("no", "first", "slots")
    units = unfolded(places, F.col("slots"), "nth", total).withColumn("unit", F.col("first") + F.col("nth"))
    big = lambda c: c.cast("decimal(19,0)")
    # The first point on a slot, of 2^bits points side by side: ceil(unit * 2^bits / slots of all sources).
    def lowest(unit: Column) -> Column:
        product = (big(unit) * big(F.lit(1 << bits)) + F.lit(total - 1)).cast("decimal(38,0)")
        return F.call_function("div", product, big(F.lit(max(1, total))))
    units = units.select("no", lowest(F.col("unit")).alias("low"), lowest(F.col("unit") + 1).alias("end"))
    other = F.when(F.col("low") + 1 < F.col("end"), reversed_bits(F.col("low") + 1, bits))
    units = units.select("no", F.least(reversed_bits(F.col("low"), bits), other).alias("slot"))
    units = units.withColumn(SEGMENT, F.expr(f"slot div {PIECE}"))
    return running_sums(units, ["no"], [F.col("slot")], {"rank": F.lit(1)}).drop(SEGMENT)


def prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def shuffled_blocks(sources: DataFrame, block: int, total: int) -> DataFrame:
    """(no, rank, turn, block, words): the blocks that each pass takes, ranked over the passes in shuffled order."""
    turns = sources.select("no", "blocks", "source_size", F.posexplode("turns").alias("turn", "limit")).where("limit > 0")
    turns = turns.withColumn("whole", F.expr(f"source_size div {block}"))
    rows = unfolded(turns, F.col("blocks"), "block", total).withColumn("digest", F.md5(F.concat_ws(":", "no", "turn", "block")))
    rows = rows.withColumn(SEGMENT, F.when(F.col("block") < F.col("whole"), prefix(F.col("digest"))).otherwise(PIECE))
    ranked = running_sums(rows, ["no", "turn"], [F.col("digest"), F.col("block")], {"place": F.lit(1)})
    words = F.least(F.lit(block), F.col("limit") - block * F.col("place"), F.col("source_size") - block * F.col("block"))
    rank = F.col("place") + F.col("turn") * F.col("blocks")
    return ranked.select("no", rank.alias("rank"), "turn", "block", words.alias("words")).where("words > 0")


class Mix:
    """The tables of a mixture.

    documents: no (of the source), nth (a row's number in it), doc_id, size, at (its first word in the source's stream).
    sources: no, source, source_size, target. schedule: slot, no, turn (pass, from 0), block, words (that the slot takes).
    spans: slot, turn, no, nth, doc_id, start (word in the document, from 0), words; in the order of slot, at + start.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2, block: int = 256,
                 id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        if min(weights) <= 0 or percent < 0 or most < 1 or block < 1:
            raise ValueError("weights, most and block must be positive, percent not negative")
        size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORDS)), F.lit(0)).cast("bigint")
        sized = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"))
        sized = materialise(sized, "sizes")  # the texts are read once
        self.sources = materialise(source_targets(sized, weights, percent, most, block), "targets")
        names = self.sources.select(F.col("source").alias("_source"), "no")
        rows = sized.join(names, F.col("source").eqNullSafe(F.col("_source"))).select("no", "doc_id", "size")
        rows = rows.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn(SEGMENT, prefix(F.col("digest")))
        rows = running_sums(rows, ["no"], [F.col("digest"), F.col("doc_id"), F.col("size")], {"at": F.col("size"), "nth": F.lit(1)})
        self.documents = materialise(rows.select("no", "nth", "doc_id", "size", "at"), "offsets")
        total = self.sources.agg(F.sum("slots")).first()[0] or 0
        self.schedule = slots(self.sources, total).join(shuffled_blocks(self.sources, block, total).hint("merge"), ["no", "rank"]).select("slot", "no", "turn", "block", "words")
        ends = F.col("at") + F.col("size")
        parts = self.documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))))
        low = F.greatest(F.col("at"), F.col("block") * block)
        parts = parts.select("no", "nth", "doc_id", "block", (low - F.col("at")).alias("start"), (low - F.col("block") * block).alias("_low"), (F.least(ends, (F.col("block") + 1) * block) - low).alias("_n"))
        taken = F.least(F.col("_n"), F.col("words") - F.col("_low"))
        self.spans = parts.join(self.schedule.hint("merge"), ["no", "block"]).select("slot", "turn", "no", "nth", "doc_id", "start", taken.alias("words")).where("words > 0")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2, block: int = 256,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How much of each document the mix of all sources takes: doc_id, size, source_size, target (of its source), taken, spans.

    Sources in order of code point, null last, weigh ``weights`` in turn and share ``percent`` of all words; a target stops at
    ``most`` times what its source has, and what is above is shared by weight among the others. A source's taken words
    equal its target rounded to a word; no document is taken more than ``most`` times. ``spans`` is the number of stretches
    in which the mix holds the document. Rows depend on nothing but ids, sources and sizes, so reruns agree.

    Null and empty texts have size 0 and are not taken; a null source is a source. Rows that repeat an id are documents of
    their own, and equal ones among them may be taken differently. Null ids are allowed. Long texts are spread over many
    blocks. Other columns are not read, so their names cannot clash. An empty table gives no rows.
    """
    mix = Mix(docs, weights, percent, most, block, id_col, text_col, source_col)
    taken = mix.spans.groupBy("no", "nth").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("spans"))
    rows = mix.documents.join(taken.hint("merge"), ["no", "nth"], "left").join(mix.sources.select("no", "source_size", "target"), "no")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return rows.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", none("taken"), none("spans"))


def mixed_text(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of each span: slot, turn, doc_id, start, text. Needs distinct ids; rows of null id are left out."""
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    joined = mix.spans.join(texts, "doc_id").withColumn("_words", F.regexp_extract_all("_text", F.lit(WORDS), F.lit(0)))
    return joined.select("slot", "turn", "doc_id", "start", F.array_join(F.slice("_words", F.col("start").cast("int") + 1, F.col("words").cast("int")), " ").alias("text"))
