"""Ontology tagging: entities, jurisdiction, confidences, mappings.

Vocabularies are parameters (code -> keywords per level). Their keywords are searched in one pass where a text
lies, and only codes and keywords travel further.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulith.functions.scoring import ontology_path, overall_confidence
from regulith.plans.keyword_kernel import FOUND, NEAR, search
from regulith.session import bind, col
from regulith.sources import ontology_terms as terms

LEVEL_COLUMNS = ["jurisdictions", "markets", "assets", "lifecycles", "requirements", "parameters"]


@dataclass(frozen=True)
class Thresholds:
    jurisdiction: float = 0.8
    market: float = 0.6
    asset: float = 0.5
    overall: float = 0.3
    fuzzy: float = 0.8
    per_level: int | None = None  # codes tried per level, all by default
    max_mappings: int | None = None  # best mappings kept per text, all by default


@dataclass(frozen=True)
class Vocabulary:
    levels: dict[str, dict[str, list[str]]] = field(default_factory=lambda: terms.LEVELS)
    patterns: dict[str, str] = field(default_factory=lambda: terms.JURISDICTION_PATTERNS)
    market_cues: list[tuple[str, list[str]]] = field(default_factory=lambda: terms.MARKET_CUES)
    default_jurisdiction: str = "guangdong"


def keyword_index(level: dict[str, list[str]]) -> dict[str, str]:
    """Keyword -> code in first-seen keyword order; a keyword listed twice belongs to the later code."""
    index: dict[str, str] = {}
    for code, words in level.items():
        for word in words:
            index[word.lower()] = code
    return index


def _pairs(index: list[tuple[str, str]]) -> Column:
    """A vocabulary level as one literal array: the plan stays small whatever the vocabulary."""
    rows = json.dumps([{"word": word, "code": code} for word, code in index], ensure_ascii=False)
    return F.from_json(F.lit(rows), "array<struct<word:string,code:string>>")


def _kind(word: str) -> str:
    """Which part of a text can contain the keyword."""
    return "_ascii" if word.isascii() else ("_wide" if not any(ch.isascii() for ch in word) else "_t")


def with_parts(docs: DataFrame, text_lower: str = "_t") -> DataFrame:
    """The ASCII runs and the other runs of a text apart, each run ended by a mark no keyword holds.

    A keyword of one kind can only lie inside a run of its kind, so it is searched in the shorter part.
    """
    t = F.col(text_lower)
    return docs.withColumns({"_ascii": F.regexp_replace(t, r"[^\x00-\x7f]+", "\u0001"), "_wide": F.regexp_replace(t, r"[\x00-\x7f]+", "\u0001")})


def entity_codes(level: dict[str, list[str]]) -> Column:
    """Codes of a level found in the parts of a text, in keyword order."""
    index = list(keyword_index(level).items())
    found = []
    for part in ("_ascii", "_wide", "_t"):
        words = [{"i": i, "word": w, "code": c} for i, (w, c) in enumerate(index) if _kind(w) == part]
        if words:
            rows = F.from_json(F.lit(json.dumps(words, ensure_ascii=False)), "array<struct<i:int,word:string,code:string>>")
            found.append(_search(rows, part))
    hits = F.array_sort(F.concat(*found)) if len(found) > 1 else found[0]
    return F.array_distinct(F.transform(hits, lambda k: k["code"]))


def _search(rows: Column, part: str) -> Column:
    return F.filter(rows, lambda k: F.contains(F.col(part), k["word"]))


def entities(docs: DataFrame, kb: Vocabulary = Vocabulary(), text_col: str = "content") -> DataFrame:
    parts = with_parts(docs.withColumn("_t", F.lower(F.col(text_col))))
    return parts.withColumns({name: entity_codes(kb.levels[name]) for name in LEVEL_COLUMNS}).drop("_t", "_ascii", "_wide")


def jurisdiction_of(found: Column, text: Column | str, kb: Vocabulary = Vocabulary()) -> Column:
    """First explicit mention, else the most frequent pattern (earlier code on a tie), else the default."""
    lowered = F.lower(col(text))
    counted = F.array(*[
        F.struct(F.regexp_count(lowered, F.lit(p)).alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("code"))
        for i, (code, p) in enumerate(kb.patterns.items())
    ])
    best = F.array_max(counted)
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.when(best["n"] > 0, best["code"]), F.lit(kb.default_jurisdiction))


def jurisdiction(docs: DataFrame, kb: Vocabulary = Vocabulary(), text_col: str = "content") -> DataFrame:
    parts = with_parts(docs.withColumn("_t", F.lower(F.col(text_col)))).withColumn("_found", entity_codes(kb.levels["jurisdictions"]))
    return parts.withColumn("jurisdiction", jurisdiction_of(F.col("_found"), "_t", kb)).drop("_t", "_ascii", "_wide", "_found")


def market_code(c: Column | str, kb: Vocabulary = Vocabulary()) -> Column:
    lowered = F.lower(col(c))
    out = F
    for code, cues in kb.market_cues:
        out = out.when(lowered.rlike("|".join(cues)), F.lit(code))
    return out.otherwise(F.lit(kb.market_cues[0][0]))


def with_keywords(docs: DataFrame, keep: list[str], levels: dict[str, dict[str, list[str]]], scored: dict[str, dict[str, list[str]]], fuzzy: float | None, ask=None) -> DataFrame:
    """``keep``, the codes of each level, the keywords that ``_t`` contains (_found) and those a word of it is near to (_near).

    ``_t`` itself stays where ``ask(codes of each level)`` holds. One pass over the texts for all keywords of ``levels`` and ``scored``.
    """
    index = {name: list(keyword_index(level).items()) for name, level in levels.items()}
    words = [w.lower() for level in scored.values() for ws in level.values() for w in ws]
    slim = docs.select(*keep, "_t")
    schema = [f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keep] + [f"`{name}` {FOUND}" for name in index]
    return slim.mapInArrow(search(list(keep), index, words, fuzzy, ask), ", ".join([*schema, f"_found {FOUND}", f"_near {NEAR}", "_t string"]))


def keyword_score(keyword: Column) -> Column:
    """1 for a contained keyword, else the best edit similarity of a word if it reaches the threshold."""
    near = F.filter("_near", lambda x: x["word"] == keyword)
    return F.when(F.array_contains("_found", keyword), F.lit(1.0)).otherwise(F.coalesce(F.try_element_at(near, F.lit(1))["sim"], F.lit(0.0)))


def code_confidence(level: dict[str, list[str]], code: Column) -> Column:
    """Mean keyword score of one code; 0 for a code the level does not define."""
    own = F.filter(_pairs([(w.lower(), c) for c, ws in level.items() for w in ws]), lambda k: k["code"] == code)
    scores = F.transform(own, lambda k: keyword_score(k["word"]))
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(total, F.size(own)), F.lit(0.0))


def keyword_confidence(docs: DataFrame, level: dict[str, list[str]], fuzzy: float | None = 0.8, text_col: str = "content", keep: list[str] = ("citation_id",)) -> DataFrame:
    """Confidence of every code of a level, one column per code."""
    prepared = docs.select(*keep, F.lower(F.col(text_col)).alias("_t"))
    return with_keywords(prepared, list(keep), {}, {"level": level}, fuzzy).select(*keep, *[code_confidence(level, F.lit(code)).alias(code) for code in level])


def _scored_level(name: str, kb: Vocabulary, t: Thresholds, default: str | None, floor: float = 0.0) -> Column:
    """Codes of a level with their confidences, or the level's default, from ``floor`` on."""
    filler = F.array(F.lit(default).cast("string"))
    codes = F.col(name) if t.per_level is None else F.slice(F.col(name), 1, t.per_level)
    chosen = F.when(F.size(name) > 0, codes).otherwise(filler)
    scored = F.transform(chosen, lambda code: F.struct(code.alias("code"), code_confidence(kb.levels[name], code).alias("conf")))
    return F.filter(scored, lambda x: x["conf"] >= floor) if floor > 0 else scored


CODES = ["market_code", "asset_type", "lifecycle", "requirement_type", "parameter_type"]
CONFIDENCES = [f"{c}_confidence" for c in ("jurisdiction", "market", "asset", "lifecycle", "requirement", "parameter")]


def _mapping(codes: list[Column], confidences: list[Column]) -> Column:
    overall = F.round(overall_confidence(*confidences), 12)
    return F.struct(*[c.cast("string").alias(n) for n, c in zip(CODES, codes)], *[c.cast("double").alias(n) for n, c in zip(CONFIDENCES, confidences)], overall.alias("overall_confidence"))


def _combinations(s: Column) -> Column:
    """One mapping for each choice of a code per level, in the order of the levels' codes."""
    def choose(levels: list[str], taken: list[Column]) -> Column:
        if not levels:
            return F.array(_mapping([x["code"] for x in taken], [s["jurisdiction"], *[x["conf"] for x in taken]]))
        return F.flatten(F.transform(s[levels[0]], lambda x: choose(levels[1:], [*taken, x])))

    return choose(["m", "a", "l", "r", "p"], [])


def ontology_map(docs: DataFrame, kb: Vocabulary = Vocabulary(), thresholds: Thresholds = Thresholds(), key: str = "citation_id",
                 text_col: str = "content", known: str | None = None) -> DataFrame:
    """Mappings of each text above the thresholds with six confidences, best first.

    All combinations of the codes found per level are built, ranked and, if ``max_mappings`` is given, cut while the text
    is one row: nothing is shuffled or written. A text without any entity gets one general mapping.
    """
    t = thresholds
    held = [key, *(["_known"] if known else [])]
    text = docs.select(key, *([F.col(known).alias("_known")] if known else []), F.lower(F.col(text_col)).alias("_t"))
    ask = lambda codes: not (any(codes.values()) if known else codes["jurisdictions"])  # the text still tells its place or market
    levels = {name: kb.levels[name] for name in LEVEL_COLUMNS}
    found = with_keywords(text, held, levels, levels, t.fuzzy, ask)
    where = F.col("_known") if known else jurisdiction_of(F.col("jurisdictions"), "_t", kb)
    any_entity = sum((F.size(c) for c in LEVEL_COLUMNS), F.lit(0)) > 0
    own = code_confidence(kb.levels["jurisdictions"], F.col("jurisdiction"))
    levels = lambda conf: F.struct(
        conf.alias("jurisdiction"),
        _scored_level("markets", kb, t, "grid_connection", t.market).alias("m"), _scored_level("assets", kb, t, "general", t.asset).alias("a"),
        _scored_level("lifecycles", kb, t, "general").alias("l"), _scored_level("requirements", kb, t, "general").alias("r"),
        _scored_level("parameters", kb, t, None).alias("p"))
    none = F.lit(None).cast("string")
    general = _mapping([market_code("_t", kb), *[F.lit("general")] * 3, none], [F.lit(x) for x in (0.8, 0.4, 0.3, 0.3, 0.3, 0.0)])
    specific = bind(own, lambda conf: F.when(conf >= t.jurisdiction, bind(levels(conf), _combinations)))
    mappings = F.when(any_entity, specific).otherwise(F.array(general))
    kept = F.filter(mappings, lambda x: x["overall_confidence"] >= t.overall)
    ordered = F.array_sort(F.transform(kept, lambda x, i: F.struct((-x["overall_confidence"]).alias("s"), i.alias("i"), x.alias("v"))))
    best = ordered if t.max_mappings is None else F.slice(ordered, 1, t.max_mappings)
    rows = found.withColumn("jurisdiction", where).select(key, "jurisdiction", F.posexplode(best).alias("_at", "_x"))
    rows = rows.select(key, "jurisdiction", *[F.col(f"_x.v.{c}").alias(c) for c in (*CODES, *CONFIDENCES, "overall_confidence")], (F.col("_at") + 1).alias("rank"))
    return rows.withColumn("path", ontology_path("jurisdiction", *CODES))


def combined_text(chunks: DataFrame, key: str = "citation_id") -> DataFrame:
    """Chunks of a citation joined in order: the text of one document. Equal documents, which share a citation, give it once."""
    ordered = F.array_sort(F.collect_set(F.struct("pos", "content")))
    return chunks.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("content"))


def enrich_citations(chunks: DataFrame, kb: Vocabulary = Vocabulary(), thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Citation rows from chunks: combined text and the asset of the best mapping."""
    scope = chunks.groupBy("citation_id").agg(F.min("province").alias("province"))
    rows = combined_text(chunks).join(scope, "citation_id")
    best = ontology_map(rows, kb, thresholds, known="province").filter("rank = 1")
    return rows.join(best.select("citation_id", F.col("asset_type").alias("asset"), "path", "overall_confidence"), "citation_id", "left")


def map_chunks(chunks: DataFrame, kb: Vocabulary = Vocabulary(), thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Per chunk: nested mappings, best first, and the best one."""
    mapped = ontology_map(chunks, kb, thresholds, key="chunk_id")
    nested = mapped.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "path", "overall_confidence", "jurisdiction", "market_code", "asset_type", "lifecycle", "requirement_type", "parameter_type"))).alias("mappings"))
    out = chunks.select("chunk_id").join(nested, "chunk_id", "left")
    best = F.try_element_at("mappings", F.lit(1))
    return out.select("chunk_id", F.coalesce(F.size("mappings"), F.lit(0)).alias("n_mappings"), "mappings", best["path"].alias("best_path"), best["overall_confidence"].alias("best_confidence"))
