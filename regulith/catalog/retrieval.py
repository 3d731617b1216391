"""Vector, full-text and hybrid retrieval."""

from __future__ import annotations

from regulith.catalog.base import query
from regulith.operators.filters import enrich_results
from regulith.plans import retrieval as r
from regulith.session import materialise

def stored(v, *names: str):
    """The named views as written tables: search reads its tables several times, like the stored ones it is meant for."""
    return [materialise(v.dealt(n), n) for n in names]


SCORED = """(select q.question_id, c.citation_id, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 12) vscore
 from question_vec q join (select * from citation_emb_v where superseded_by is null) c on q.province = c.province and q.doc_class = c.doc_class and (q.asset is null or q.asset = c.asset))"""
TOPK = "select question_id, citation_id, vscore, row_number() over (partition by question_id order by vscore desc, citation_id) \"rank\" from " + SCORED


@query("j8_scoped_scores", f"select question_id, citation_id, <<r:vscore>> vscore from ({TOPK}) where \"rank\" <= 200")
def _(v):
    return r.vector_topk(v("question_vec"), v("citation_emb_v"), k=200).drop("rank")


@query("x1_vector_topk", f"select question_id, citation_id, <<r:vscore>> vscore, \"rank\" from ({TOPK}) where \"rank\" <= 10")
def _(v):
    return r.vector_topk(v("question_vec"), v("citation_emb_v"), k=10)


@query("k2_vector_topk_threshold", f"select question_id, citation_id, <<r:vscore>> vscore, \"rank\" from ({TOPK}) where \"rank\" <= 5 and vscore >= 0.1")
def _(v):
    return r.vector_topk(v("question_vec"), v("citation_emb_v"), k=5, threshold=0.1)


@query("x1_vector_topk_grid", f"select question_id, citation_id, <<r:vscore>> vscore, \"rank\" from ({TOPK}) where \"rank\" <= 10")
def _(v):
    return r.vector_topk(v("question_vec"), v("citation_emb_v"), k=10, max_broadcast=0, q_block=64, c_block=128)


def toks(c: str, zh: bool = False) -> str:
    """Runs of letters, digits and underscore; with ``zh`` a run of Chinese characters is its pairs."""
    if not zh:
        return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
    runs = rf"regexp_extract_all(regexp_replace(lower({c}), '([\x{{4e00}}-\x{{9fff}}]+)', ' \1 ', 'g'), '[\p{{L}}\p{{N}}_]+')"
    return rf"""flatten(list_transform({runs}, lambda r: case when length(r) > 1 and regexp_matches(r, '^[\x{{4e00}}-\x{{9fff}}]')
 then list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) else [r] end))"""


def all_terms(questions: str, docs: str, zh: bool = False) -> str:
    return f"""q as (select question_id, province, doc_class, asset, list_distinct({toks('question', zh)}) terms from {questions}),
 d as (select citation_id, province, doc_class, asset, {toks('content', zh)} tokens from {docs}),
 hit as (select q.question_id, d.citation_id, q.terms, d.tokens from q join d on q.province = d.province and q.doc_class = d.doc_class and (q.asset is null or q.asset = d.asset)
  and len(q.terms) > 0 and list_has_all(d.tokens, q.terms))"""


# The minimal spans that hold all terms, one row each, from the places of the terms in the matching texts.
DENSITY = """e as (select *, row_number() over (partition by question_id, citation_id order by pos) nth from (select question_id, citation_id, terms, unnest(tokens) term, generate_subscripts(tokens, 1) pos from hit) where list_contains(terms, term)),
 lasts as (select a.question_id, a.citation_id, a.pos, a.nth, len(a.terms) n, b.term, max(b.pos) last_at, max(b.nth) last_nth from e a join e b on a.question_id = b.question_id and a.citation_id = b.citation_id and b.pos <= a.pos group by all),
 spans as (select question_id, citation_id, pos, nth, min(last_at) start_at, min(last_nth) start_nth from lasts group by question_id, citation_id, pos, nth, n having count(*) = n),
 minimal as (select question_id, citation_id, start_at, start_nth, min(pos) end_at, min(nth) end_nth from spans group by 1, 2, 3, 4),
 density as (select question_id, citation_id, sum(0.1::double / (1 + (end_at - start_at) - (end_nth - start_nth))) tscore from minimal group by 1, 2)"""


@query("x2_text_hits", f"with {all_terms('sentence_v', 'citation_base')} select question_id, citation_id from hit")
def _(v):
    return r.text_hits(v("sentence_v"), v.dealt("citation_base"))


@query("x2_text_rank", f"with {all_terms('sentence_v', 'citation_base')}, {DENSITY} select question_id, citation_id, <<r:tscore>> tscore from density")
def _(v):
    return r.text_rank(v("sentence_v"), v.dealt("citation_base"))


@query("x2_text_rank_zh", f"with {all_terms('question_zh_v', 'citation_zh_v', zh=True)}, {DENSITY} select question_id, citation_id, <<r:tscore>> tscore from density")
def _(v):
    return r.text_rank(v("question_zh_v"), v.dealt("citation_zh_v"))


def bm25_sql(pairs: str, questions: str, docs: str, zh: bool = False) -> str:
    return f"""dt as (select citation_id, {toks('content', zh)} tokens from {docs}),
 tf as (select citation_id, term, len, count(*) tf from (select citation_id, len(tokens) len, unnest(tokens) term from dt) group by all),
 dfs as (select term, count(*) df from tf group by 1), st as (select count(*) n, avg(len(tokens)) avgdl from dt),
 qt as (select question_id, unnest(list_distinct({toks('question', zh)})) term from {questions}),
 bm as (select p.question_id, p.citation_id, sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / st.avgdl))) tscore
  from {pairs} p join qt using (question_id) join tf on tf.citation_id = p.citation_id and tf.term = qt.term join dfs on dfs.term = qt.term, st group by 1, 2)"""


ACTIVE = "act as (select * from citation_emb_v where superseded_by is null)"
POOL = f"pool as (select * from ({TOPK}) where \"rank\" <= 200)"


@query("x2b_bm25", f"with {ACTIVE}, {POOL}, {bm25_sql('pool', 'question_vec', 'act')} select question_id, citation_id, <<r:tscore>> tscore from bm")
def _(v):
    q, c = stored(v, "question_vec", "citation_emb_v")
    c = c.filter("superseded_by is null")
    return r.bm25(q, r.vector_pools(q, c, 200), c)


HYBRID = f"""{ACTIVE}, {POOL}, {bm25_sql('pool', 'question_vec', 'act')},
 merged as (select p.question_id, p.citation_id, vscore, coalesce(tscore, 0) ts from pool p left join bm using (question_id, citation_id)),
 scaled as (select question_id, citation_id, vscore, case when max(ts) over w > min(ts) over w then (ts - min(ts) over w) / (max(ts) over w - min(ts) over w) when ts > 0 then 1.0 else 0.0 end tscore
  from merged window w as (partition by question_id)),
 hybrid as (select *, row_number() over (partition by question_id order by score desc, citation_id) "rank" from (select *, round(0.6 * vscore + 0.4 * tscore, 12) score from scaled) qualify "rank" <= 20)"""


@query("x3_hybrid_search", f"""with {HYBRID} select h.question_id, h.citation_id, <<r:h.score>> score, <<r:h.vscore>> vector_score, <<r:h.tscore>> text_score, h."rank", c.title, c.url, <<d:c.effective_date>> effective_date,
 case when length(c.content) <= 500 then c.content else substr(c.content, 1, 500) || '...' end passage from hybrid h join act c using (citation_id)""")
def _(v):
    hits = enrich_results(r.hybrid_passages(*stored(v, "question_vec", "citation_emb_v")))
    return hits.select("question_id", "citation_id", "score", "vector_score", "text_score", "rank", "metadata.title", "metadata.url", "metadata.effective_date", "passage")


def in_pool(questions: str, docs: str) -> str:
    return SCORED.replace("question_vec", questions).replace("(select * from citation_emb_v where superseded_by is null)", docs)


ZH_POOL = f"""pool as (select * from (select question_id, citation_id, vscore, row_number() over (partition by question_id order by vscore desc, citation_id) "rank"
 from {in_pool('question_zh_v', 'citation_zh_emb_v')}) where "rank" <= 200)"""


@query("x2b_bm25_zh", f"with {ZH_POOL}, {bm25_sql('pool', 'question_zh_v', 'citation_zh_emb_v', zh=True)} select question_id, citation_id, <<r:tscore>> tscore from bm")
def _(v):
    q, c = stored(v, "question_zh_v", "citation_zh_emb_v")
    return r.bm25(q, r.vector_pools(q, c, 200), c)


@query("x3_hybrid_text_rank", f"""with {ZH_POOL}, {all_terms('question_zh_v', 'citation_zh_emb_v', zh=True)}, {DENSITY},
 blended as (select p.question_id, p.citation_id, vscore, coalesce(tscore, 0) tscore, round(0.6 * vscore + 0.4 * coalesce(tscore, 0), 12) score from pool p left join density using (question_id, citation_id))
 select question_id, citation_id, <<r:vscore>> vscore, <<r:tscore>> tscore, <<r:score>> score, row_number() over (partition by question_id order by score desc, citation_id) "rank" from blended qualify "rank" <= 20""")
def _(v):
    q, c = stored(v, "question_zh_v", "citation_zh_emb_v")
    return r.hybrid_scores(q, c, text_score="text_rank")
