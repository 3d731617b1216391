"""Citation-sized chunks: clause splitting and greedy packing as folds over arrays.

Every document is one row and stays one row until the finished chunks are exploded: no shuffle.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulith.functions.layout import block_confidences, page_tables, paragraphs
from regulith.functions.text import language_label, stable_id, strip, token_estimate
from regulith.session import bind, col
from regulith.sources import vocab

MAX_TOKENS, OVERLAP_TOKENS, MIN_CLAUSE_CHARS, MIN_CHUNK_TOKENS = 800, 100, 50, 50

# Places where a clause may begin, applied in this order.
CLAUSE_STARTS = [
    "(?=第[一二三四五六七八九十百千万]+条)",
    r"(?=[（(][一二三四五六七八九十百千万\d]+[）)])",
    r"(?<!\d)(?=\d+[.、])",
    "(?=[。！？；])",
    r"(?=[：:]\s*[（(一二三四五六七八九十\d])",
    "(?=同时|另外|此外|其中|包括|具体|特别|尤其)",
]

# One of these occurs in every text the pattern at the same place matches; a search for them is far cheaper than the pattern.
START_SIGNS = ["第", "（(", ".、", "。！？；", "：:", ["同时", "另外", "此外", "其中", "包括", "具体", "特别", "尤其"]]

CLAUSES = "array<struct<c:string,t:int>>"
CHUNKS = "array<struct<clauses:array<string>,tokens:int>>"


def _cut(pattern: str, signs):
    """Pieces of a text before each match of a zero-width pattern, as a one-argument function; a text without any of the signs is one piece."""
    absent = lambda text: functools.reduce(operator.and_, [~F.contains(text, F.lit(sign)) for sign in signs])
    return lambda text: F.transform(F.when(absent(text), F.array(text)).otherwise(F.split(text, pattern)), strip)


def split_clauses(paras: Column | str, min_chars: int = MIN_CLAUSE_CHARS) -> Column:
    """Atomic clauses: each marker starts a new clause; clauses below the minimum are left out."""
    parts = col(paras)
    for pattern, signs in zip(CLAUSE_STARTS, START_SIGNS, strict=True):
        # A digit is looked for before what stands around it.
        parts = F.flatten(F.transform(parts, _cut(rf"(?=\d){pattern}" if pattern.startswith(r"(?<!\d)") else pattern, signs)))
        parts = F.filter(parts, lambda p: F.length(p) > 0)
    return F.filter(parts, lambda p: F.length(p) >= min_chars)


def pack_clauses(clauses: Column | str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """Greedy packing with overlap: array<struct<clauses, tokens>>.

    When a clause does not fit, the current chunk is closed and its last clauses, up to ``overlap``
    tokens, open the next one. If even the overlap leaves no room for the clause it is dropped, so a
    chunk exceeds the maximum only when a single clause does.
    """
    measured = F.transform(col(clauses), lambda c: F.struct(c.alias("c"), token_estimate(c).alias("t")))
    no_clauses, no_chunks = F.array().cast(CLAUSES), F.array().cast(CHUNKS)
    close = lambda s: F.struct(F.transform(s["cur"], lambda x: x["c"]).alias("clauses"), s["tok"].alias("tokens"))
    state = lambda done, cur, tok: F.struct(done.alias("done"), cur.alias("cur"), tok.alias("tok"))

    def tail(cur):
        return F.aggregate(
            F.reverse(cur), F.struct(no_clauses.alias("ov"), F.lit(0).alias("tok"), F.lit(True).alias("open")),
            lambda a, x: F.when(
                a["open"] & (a["tok"] + x["t"] <= overlap),
                F.struct(F.concat(F.array(x), a["ov"]).alias("ov"), (a["tok"] + x["t"]).alias("tok"), F.lit(True).alias("open")),
            ).otherwise(F.struct(a["ov"].alias("ov"), a["tok"].alias("tok"), F.lit(False).alias("open"))),
        )

    def step(s, x):
        def reopened(o):
            fits = o["tok"] + x["t"] <= max_tokens
            return state(
                F.concat(s["done"], F.array(close(s))),
                F.when(fits, F.concat(o["ov"], F.array(x))).otherwise(F.array(x)),
                F.when(fits, o["tok"] + x["t"]).otherwise(x["t"]),
            )

        full = (s["tok"] + x["t"] > max_tokens) & (F.size(s["cur"]) > 0)
        return F.when(full, bind(tail(s["cur"]), reopened)).otherwise(
            state(s["done"], F.concat(s["cur"], F.array(x)), s["tok"] + x["t"]))

    final = F.aggregate(measured, state(no_chunks, no_clauses, F.lit(0)), step)
    return bind(final, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["done"], F.array(close(s)))).otherwise(s["done"]))


def merge_short_chunks(chunks: Column | str, min_tokens: int = MIN_CHUNK_TOKENS, max_tokens: int = MAX_TOKENS) -> Column:
    """A chunk below the minimum takes in its successor when both fit; the merged one is final."""
    none = F.lit(None).cast("struct<clauses:array<string>,tokens:int>")
    state = lambda out, held: F.struct(out.alias("out"), held.alias("held"))

    def step(s, x):
        held = s["held"]
        merged = F.struct(F.concat(held["clauses"], x["clauses"]).alias("clauses"), (held["tokens"] + x["tokens"]).alias("tokens"))
        fits = (held["tokens"] < min_tokens) & (held["tokens"] + x["tokens"] <= max_tokens)
        return (
            F.when(held.isNull(), state(s["out"], x)).when(fits, state(F.concat(s["out"], F.array(merged)), none))
            .otherwise(state(F.concat(s["out"], F.array(held)), x))
        )

    final = F.aggregate(col(chunks), state(F.array().cast(CHUNKS), none), step)
    return bind(final, lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["held"]))))


def clause_type(c: Column | str) -> Column:
    """First matching type; a table needs at least four bars; otherwise general."""
    out = F
    for name, pattern in vocab.CLAUSE_TYPES:
        out = out.when(col(c).rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("general"))


def chunk_document(docs: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS,
                   min_clause: int = MIN_CLAUSE_CHARS, min_chunk: int = MIN_CHUNK_TOKENS) -> DataFrame:
    """(doc_id, paragraphs) -> one row per chunk with id, content, tokens, type and place."""
    packed = docs.select(
        "doc_id", F.array_join("paragraphs", "\n").alias("_full"),
        merge_short_chunks(pack_clauses(split_clauses("paragraphs", min_clause), max_tokens, overlap), min_chunk, max_tokens).alias("_chunks"),
    )
    # The place of a chunk is the place of its first clause, found while the document is still one row.
    placed = F.transform("_chunks", lambda k: F.struct(
        F.array_join(k["clauses"], "\n").alias("content"), k["tokens"].alias("token_count"),
        F.greatest(F.position(F.element_at(k["clauses"], 1), F.col("_full")) - 1, F.lit(0)).alias("start_char")))
    rows = packed.select("doc_id", F.posexplode(placed).alias("pos", "k")).select("doc_id", "pos", "k.*")
    return rows.select(
        "doc_id", "pos", stable_id(F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("chunk_id"), "content",
        "start_char", (F.col("start_char") + F.length("content")).alias("end_char"), "token_count", clause_type("content").alias("clause_type"))


def chunk_text(docs: DataFrame, max_tokens: int = MAX_TOKENS, overlap_chars: int = 100, sep: str = "\n\n") -> DataFrame:
    """Paragraph chunks with a character overlap; a paragraph above the maximum is packed by sentence."""
    paras = F.filter(F.transform(F.split("text", sep), strip), lambda p: F.length(p) > 0)
    unit = lambda text, glue: F.struct(text.alias("c"), token_estimate(text, "chars").alias("t"), F.lit(glue).alias("glue"))
    units = F.flatten(F.transform(paras, lambda p: F.when(
        token_estimate(p, "chars") > max_tokens,
        F.transform(F.filter(F.transform(F.split(p, "[。！？；]"), strip), lambda x: F.length(x) > 0), lambda x: unit(x, "")),
    ).otherwise(F.array(unit(p, sep)))))
    no_chunks = F.array().cast("array<struct<text:string,tokens:int>>")
    state = lambda done, cur, tok: F.struct(done.alias("done"), cur.alias("cur"), tok.alias("tok"))

    def step(s, x):
        closed = F.concat(s["done"], F.array(F.struct(s["cur"].alias("text"), s["tok"].alias("tokens"))))
        restarted = F.concat(F.right(s["cur"], F.lit(overlap_chars)), x["glue"], x["c"]) if overlap_chars > 0 else x["c"]
        joined = F.when(F.length(s["cur"]) > 0, F.concat(s["cur"], x["glue"], x["c"])).otherwise(x["c"])
        full = (s["tok"] + x["t"] > max_tokens) & (F.length(s["cur"]) > 0)
        return F.when(full, state(closed, restarted, token_estimate(restarted, "chars"))).otherwise(state(s["done"], joined, s["tok"] + x["t"]))

    final = F.aggregate(units, state(no_chunks, F.lit(""), F.lit(0)), step)
    chunks = bind(final, lambda s: F.when(
        F.length(strip(s["cur"])) > 0, F.concat(s["done"], F.array(F.struct(s["cur"].alias("text"), s["tok"].alias("tokens"))))).otherwise(s["done"]))
    lengths = F.transform("_k", lambda k: F.length(strip(k["text"])))
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    rows = docs.select("doc_id", chunks.alias("_k")).withColumn("_s", starts)
    rows = rows.select("doc_id", "_s", F.posexplode("_k").alias("pos", "k"))
    return rows.select(
        "doc_id", "pos", F.concat(F.lit("chunk_"), F.lpad((F.col("pos") + 1).cast("string"), F.greatest(F.lit(3), F.length((F.col("pos") + 1).cast("string"))), F.lit("0"))).alias("chunk_id"),
        strip("k.text").alias("content"), F.col("k.tokens").alias("token_count"), F.get("_s", "pos").alias("start_pos"),
        (F.get("_s", "pos") + F.length("k.text")).alias("end_pos"))


def split_chunks(docs: DataFrame) -> DataFrame:
    """Blank-line split: (doc_id, ordinal, title, content)."""
    rows = docs.select("doc_id", "title", F.posexplode(F.split("content", "\n\n")).alias("pos", "part")).filter(F.length(strip("part")) > 0)
    ordinal = F.col("pos") + 1
    return rows.select("doc_id", ordinal.alias("ordinal"), F.concat("title", F.lit(" - 第"), ordinal.cast("string"), F.lit("部分")).alias("title"), strip("part").alias("content"))


def with_paragraphs(layout_docs: DataFrame) -> DataFrame:
    pages = "pages" if "pages" in layout_docs.columns else None
    return layout_docs.withColumn("paragraphs", paragraphs("text", pages))


def layout_metadata(layout_docs: DataFrame) -> DataFrame:
    """Counts and mean block confidence per document, from the nested arrays directly."""
    conf = block_confidences(F.col("pages"))
    tables = page_tables(F.col("pages"), F.col("text"))
    mean = F.aggregate(conf, F.lit(0.0), lambda a, x: a + x) / F.size(conf)
    return with_paragraphs(layout_docs).select(
        "doc_id", F.size("pages").alias("page_count"), F.length("text").alias("text_length"), F.size(tables).alias("table_count"),
        (F.size(tables) > 0).alias("has_tables"), F.size("paragraphs").alias("paragraph_count"),
        F.when(F.size(conf) > 0, mean).otherwise(0.0).alias("avg_confidence"), language_label("text").alias("language"))


def embed_prepare(chunks: DataFrame, model: str = "text-embedding", dimension: int = 768, max_len: int | None = None) -> DataFrame:
    """Cleaned text with its ids, ready for an embedding model; whole, unless ``max_len`` cuts it to a prefix."""
    cleaned = F.regexp_replace(strip("content"), r"\s+", " ")
    text = cleaned if max_len is None else F.substring(cleaned, 1, max_len)
    return chunks.select("citation_id", "chunk_id", text.alias("text"), F.lit(model).alias("model"), F.lit(dimension).alias("dimension"), "province", "doc_class")


