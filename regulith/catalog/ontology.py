"""Ontology tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from regulith.catalog.base import query
from regulith.catalog.scalar import OVERALL
from regulith.functions.scoring import overall_confidence
from regulith.operators.aggregates import ontology_coverage
from regulith.plans import chunking
from regulith.plans import ontology as o
from regulith.sources import ontology_terms as terms

LOW = o.Thresholds(jurisdiction=0.1, market=0.05, asset=0.05, overall=0.05, fuzzy=None, per_level=2, max_mappings=5)


def codes_sql(level: dict[str, list[str]], t: str = "lower(content)") -> str:
    hits = ", ".join(f"case when contains({t}, '{w}') then '{c}' end" for w, c in o.keyword_index(level).items())
    return f"(select list_filter(l, lambda x, i: list_position(l, x) = i) from (select list_filter([{hits}], lambda x: x is not null) l))"


def conf_sql(words: list[str], t: str = "lower(content)") -> str:
    return "((" + " + ".join(f"contains({t}, '{w.lower()}')::int" for w in words) + f")::double / {len(words)})"


ENTITIES = "(select citation_id, doc_id, province, content, " + ", ".join(f"{codes_sql(level)} {name}" for name, level in terms.LEVELS.items()) + " from citation_zh_v)"


@query("x11_entities", "select citation_id, " + ", ".join(f"<<a:{n}>> {n}" for n in terms.LEVELS) + f" from {ENTITIES}")
def _(v):
    return o.entities(v.dealt("citation_zh_v")).select("citation_id", *o.LEVEL_COLUMNS)


COUNTS = {c: f"len(regexp_extract_all(lower(content), '{p}'))" for c, p in terms.JURISDICTION_PATTERNS.items()}
BEST = "greatest(" + ", ".join(COUNTS.values()) + ")"
ARGMAX = "case when " + BEST + " = 0 then 'guangdong' " + " ".join(f"when {n} = {BEST} then '{c}'" for c, n in COUNTS.items()) + " end"
JURISDICTION = f"coalesce(jurisdictions[1], {ARGMAX})"


@query("x12_jurisdiction", f"select citation_id, {JURISDICTION} jurisdiction from {ENTITIES}")
def _(v):
    return o.jurisdiction(v("citation_zh_v")).select("citation_id", "jurisdiction")


@query("x13_keyword_confidence", "select citation_id, " + ", ".join(f"<<r:{conf_sql(w)}>> {c}" for c, w in terms.MARKETS.items()) + " from citation_zh_v")
def _(v):
    return o.keyword_confidence(v.dealt("citation_zh_v"), terms.MARKETS, fuzzy=None)


KEYWORDS = ", ".join(f"('{c}', '{w.lower()}', {len(ws)})" for c, ws in terms.LIFECYCLES.items() for w in ws)


@query("x13_fuzzy_confidence", r"""with t as (select citation_id, lower(content) t from citation_zh_v), k as (select * from (values """ + KEYWORDS + r""") k(code, word, n)),
 w as (select distinct citation_id, x from (select citation_id, unnest(regexp_split_to_array(t, '\s+')) x from t)),
 vocab as (select distinct x from w), sims as (select x, word, 1 - levenshtein(word, x)::double / greatest(length(word), length(x)) sim from vocab join (select distinct word from k) on length(x) between length(word) * 0.8 and length(word) / 0.8),
 best as (select citation_id, word, max(sim) sim from w join sims using (x) where sim >= 0.8 group by 1, 2),
 scored as (select t.citation_id, k.code, sum(case when contains(t.t, k.word) then 1.0::double else coalesce(best.sim, 0) end) / any_value(n) s from t join k on true left join best on best.citation_id = t.citation_id and best.word = k.word group by 1, 2)
 select citation_id, """ + ", ".join(f"<<r:max(s) filter (code = '{c}')>> {c}" for c in terms.LIFECYCLES) + " from scored group by 1")
def _(v):
    return o.keyword_confidence(v.dealt("citation_zh_v"), terms.LIFECYCLES, fuzzy=0.8)


def scored_sql(name: str, default: str | None) -> str:
    """Rows (citation_id, code, conf, at) of the first two codes of a level, or its default."""
    level = terms.LEVELS[name]
    case = "case code " + " ".join(f"when '{c}' then {conf_sql(w)}" for c, w in level.items()) + " else 0.0 end"
    filler = "[null]" if default is None else f"['{default}']"
    picked = f"case when len({name}) > 0 then {name}[1:2] else {filler} end"
    return f"(select citation_id, code, {case} conf, pos from (select citation_id, content, unnest({picked}) code, unnest(range(0, len({picked}))) pos from ent))"


JCONF = "case jurisdiction " + " ".join(f"when '{c}' then {conf_sql(w)}" for c, w in terms.JURISDICTIONS.items()) + " else 0.0 end"
MARKET = "case " + " ".join(f"when regexp_matches(lower(content), '{'|'.join(cues)}') then '{c}'" for c, cues in terms.MARKET_CUES) + " else 'grid_connection' end"
ANY = " + ".join(f"len({n})" for n in terms.LEVELS) + " > 0"


def map_sql(jurisdiction: str) -> str:
    return f"""ent as (select *, {jurisdiction} jurisdiction from {ENTITIES}), jc as (select citation_id, jurisdiction, {JCONF} jconf, {ANY} any_entity, {MARKET} market from ent),
 m as {scored_sql('markets', 'grid_connection')}, a as {scored_sql('assets', 'general')}, l as {scored_sql('lifecycles', 'general')}, r as {scored_sql('requirements', 'general')}, p as {scored_sql('parameters', None)},
 combos as (select jc.citation_id, jurisdiction, m.code market_code, a.code asset_type, l.code lifecycle, r.code requirement_type, p.code parameter_type, jconf jurisdiction_confidence, m.conf market_confidence, a.conf asset_confidence,
  l.conf lifecycle_confidence, r.conf requirement_confidence, p.conf parameter_confidence, (((m.pos * 2 + a.pos) * 2 + l.pos) * 2 + r.pos) * 2 + p.pos seq from jc join m using (citation_id) join a using (citation_id) join l using (citation_id)
  join r using (citation_id) join p using (citation_id) where any_entity and jconf >= 0.1 and m.conf >= 0.05 and a.conf >= 0.05
  union all select citation_id, jurisdiction, market, 'general', 'general', 'general', null, 0.8, 0.4, 0.3, 0.3, 0.3, 0.0, 0 from jc where not any_entity),
 mapped as (select *, row_number() over (partition by citation_id order by overall desc, seq) "rank" from (select *, round({OVERALL}, 12) overall from combos where {OVERALL} >= 0.05) qualify row_number() over (partition by citation_id order by overall desc, seq) <= 5)"""


@query("x14_ontology_map", f"""with {map_sql(JURISDICTION)} select citation_id, "rank", concat_ws(' → ', jurisdiction, market_code, asset_type, lifecycle, requirement_type, parameter_type) path, <<r:overall>> overall_confidence from mapped""")
def _(v):
    return o.ontology_map(v.dealt("citation_zh_v"), thresholds=LOW).select("citation_id", "rank", "path", "overall_confidence")


@query("x14_ontology_map_default")
def _(v):
    return o.ontology_map(v.dealt("citation_zh_v")).select("citation_id", "rank", "path", "overall_confidence")


@query("x15_market_code", f"select citation_id, {MARKET} market_code from citation_zh_v")
def _(v):
    return v("citation_zh_v").select("citation_id", o.market_code("content").alias("market_code"))


def _chunks(v):
    docs = v("citation_zh_v")
    parts = chunking.split_chunks(docs).select("doc_id", F.col("ordinal").alias("pos"), "content")
    return parts.join(docs.select("doc_id", "citation_id", "province"), "doc_id").withColumn("chunk_id", F.concat_ws("-", "citation_id", "pos"))


REJOINED = r"""citation_zh_joined as (select * replace ((select string_agg(s, chr(10) order by i) from (select regexp_replace(s0, '^\s+|\s+$', '', 'g') s, i from (select unnest(string_split(content, chr(10) || chr(10))) s0,
 unnest(range(0, len(string_split(content, chr(10) || chr(10))))) i)) where length(s) > 0) as content) from citation_zh_v)"""


@query("x16_enrich_citations", f"""with {REJOINED}, {map_sql('province').replace('from citation_zh_v)', 'from citation_zh_joined)')} select c.citation_id, c.content, b.asset_type asset, <<r:b.overall>> overall_confidence
 from citation_zh_joined c left join (select * from mapped where "rank" = 1) b using (citation_id)""")
def _(v):
    return o.enrich_citations(_chunks(v), thresholds=LOW).select("citation_id", "content", "asset", "overall_confidence")


CHUNKED = r"""chunk_src as (select citation_id || '-' || (i + 1) citation_id, doc_id, province, s content from (select citation_id, doc_id, province, i, regexp_replace(s0, '^\s+|\s+$', '', 'g') s from (select citation_id, doc_id, province, unnest(string_split(content, chr(10) || chr(10))) s0,
 unnest(range(0, len(string_split(content, chr(10) || chr(10))))) i from citation_zh_v)) where length(s) > 0)"""


@query("x17_map_chunks", f"""with {CHUNKED}, {map_sql(JURISDICTION).replace('from citation_zh_v)', 'from chunk_src)')} select c.citation_id chunk_id, count(m.path) n_mappings, min(m.path) filter (m."rank" = 1) best_path, <<r:min(m.overall) filter (m."rank" = 1)>> best_confidence
 from chunk_src c left join (select *, concat_ws(' → ', jurisdiction, market_code, asset_type, lifecycle, requirement_type, parameter_type) path from mapped) m using (citation_id) group by 1""")
def _(v):
    return o.map_chunks(_chunks(v), thresholds=LOW).select("chunk_id", "n_mappings", "best_path", "best_confidence")


@query("a24_ontology_coverage", f"""select *, total_chunks - mapped unmapped from (select count(*) mapped, <<r:avg(c)>> avg_confidence, count(*) filter (c >= 0.7) high, count(*) filter (c >= 0.4 and c < 0.7) medium, count(*) filter (c < 0.4) low,
 count(distinct jurisdiction) jurisdictions, count(distinct market_code) market_codes, count(distinct asset_type) asset_types, (select count(*) from citation_base) total_chunks from (select *, {OVERALL} c from mapping_v))""")
def _(v):
    conf = [F.col(f"{c}_confidence").cast("double") for c in ("jurisdiction", "market", "asset", "lifecycle", "requirement", "parameter")]
    return ontology_coverage(v("mapping_v").withColumn("overall_confidence", overall_confidence(*conf)), v("citation_base"))
