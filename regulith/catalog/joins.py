"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from regulith.catalog.base import query
from regulith.catalog.filters import ALLOWED
from regulith.operators.dictionary import contained_terms, near_terms
from regulith.operators import joins as j
from regulith.operators.windows import order_by_rank
from regulith.session import materialise
from regulith.sources import vocab


def case_any(text: str, rules: dict[str, list[str]], default: str) -> str:
    whens = " ".join(f"when regexp_matches({text}, '{'|'.join(words)}') then '{name}'" for name, words in rules.items())
    return f"case {whens} else '{default}' end"


def case_map(c: str, mapping: dict[str, str], default: str = "null") -> str:
    return f"case {c} " + " ".join(f"when '{k}' then '{x}'" for k, x in mapping.items()) + f" else {default} end"


@query("j1_merge_scores", "select a.citation_id, <<r:a.doc_id / 7.0>> vscore, <<r:coalesce(b.doc_id / 3.0, 0)>> tscore from citation_base a left join (select * from citation_base where asset = 'wind') b using (citation_id)")
def _(v):
    base = v("citation_base").select("citation_id", "doc_id", "asset")
    vec = base.select("citation_id", (F.col("doc_id") / 7.0).alias("vscore"))
    txt = base.filter("asset = 'wind'").select("citation_id", (F.col("doc_id") / 3.0).alias("tscore"))
    return j.merge_scores(vec, txt, ["citation_id"])


@query("j2_with_source", "select p.page_id, s.label, s.province from (select page_id, domain from snapshot_v) p join source_v s using (domain)")
def _(v):
    return j.with_source(v("snapshot_v").select("page_id", "domain"), v("source_v").select("domain", "label", "province")).drop("domain")


@query("j3_domain_anti_join", "select page_id from snapshot_v s where not " + ALLOWED.replace("{d}", "s.domain"))
def _(v):
    return j.domain_semi_join(v("snapshot_v").select("page_id", "domain"), v("allow_v"), anti=True).select("page_id")


@query("j4_match_keywords", " union all ".join(
    f"select citation_id, '{name}' topic from citation_zh_v where regexp_matches(lower(content), '{'|'.join(words)}')" for name, words in vocab.ANSWER_TOPICS.items()))
def _(v):
    return j.match_keywords(v("citation_zh_v"), vocab.ANSWER_TOPICS, "content", "citation_id")


SYNC_OLD = "(select domain, label, case when length(domain) % 3 = 0 then 'disallow' else robots end robots, fetch_method from source_v where priority <> 'low' union all select 'old-' || domain, label, robots, fetch_method from source_v where priority = 'urgent')"
SYNC_NEW = "(select domain, label, robots, fetch_method from source_v where priority <> 'medium')"
SYNC_SQL = f"""select coalesce(n.domain, o.domain) "domain", case when o.domain is null then 'insert' when n.domain is null then 'orphan'
 when n.label is not distinct from o.label and n.robots is not distinct from o.robots and n.fetch_method is not distinct from o.fetch_method then 'noop' else 'update' end "action"
 from {SYNC_NEW} n full outer join {SYNC_OLD} o on n.domain = o.domain"""
SYNC_COLS = ["label", "robots", "fetch_method"]


def sync_sides(v):
    src = v("source_v").select("domain", "priority", *SYNC_COLS)
    new = src.filter("priority <> 'medium'").drop("priority")
    old = src.filter("priority <> 'low'").drop("priority").withColumn("robots", F.when(F.length("domain") % 3 == 0, "disallow").otherwise(F.col("robots")))
    gone = src.filter("priority = 'urgent'").drop("priority").withColumn("domain", F.concat(F.lit("old-"), "domain"))
    return new, old.unionByName(gone)


@query("j5_sync_diff", SYNC_SQL)
def _(v):
    new, old = sync_sides(v)
    return j.sync_diff(new, old, "domain", SYNC_COLS).select("domain", "action")


@query("j6_with_superseding", "select a.citation_id, a.superseded_by, b.title new_title, <<d:b.effective_date>> new_date from citation_v a left join citation_v b on a.superseded_by = b.citation_id")
def _(v):
    c = v("citation_v").select("citation_id", "superseded_by", "title", "effective_date")
    return j.with_superseding(c).select("citation_id", "superseded_by", "new_title", "new_date")


@query("j7_mark_duplicates", "select page_id, nullif(first_value(page_id) over (partition by checksum order by fetched_at, page_id), page_id) duplicate_of from snapshot_v")
def _(v):
    return j.mark_duplicates(v("snapshot_v").select("page_id", "checksum", "fetched_at")).select("page_id", "duplicate_of")


@query("j9_priority_sources", """select s.domain, a.asset wanted_asset, case s.priority when 'urgent' then 0 when 'high' then 1 when 'medium' then 2 else 3 end priority_rank
 from source_v s join (select domain, asset, doc_classes[1:1] wanted_classes from source_v where asset is not null) a on s.domain = a.domain
 where s.enabled and len(list_intersect(s.doc_classes, a.wanted_classes)) > 0""")
def _(v):
    src = v("source_v")
    wanted = src.filter("asset is not null").select("domain", F.col("asset").alias("wanted_asset"), F.slice("doc_classes", 1, 1).alias("wanted_classes"))
    return order_by_rank(j.priority_sources(src.drop("asset"), wanted)).select("domain", "wanted_asset", "priority_rank")


@query("j10_contained_in", "select b.item_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text)")
def _(v):
    return j.contained_in(v("benchmark"), v.dealt("documents"), "item_id", "text", "doc_id", "text")


ZH_ALL_CLAUSES = """(select doc_id clause_id, substr(content, cast(1 + doc_id % 9 as int), cast(2 + doc_id % 11 as int)) clause from citation_zh_v)"""


def _zh_clauses(docs):
    return docs.select(F.col("doc_id").alias("clause_id"), F.expr("substr(content, cast(1 + doc_id % 9 as int), cast(2 + doc_id % 11 as int))").alias("clause"))


def _zh_contained(v):
    docs = materialise(v.dealt("citation_zh_v").select("doc_id", "content"), "citation_zh_v")  # read several times
    return j.contained_in(_zh_clauses(docs), docs, "clause_id", "clause", "doc_id", "content")


ZH_CONTAINED = f"select a.clause_id, d.doc_id from {ZH_ALL_CLAUSES} a join citation_zh_v d on contains(d.content, a.clause)"


@query("j10_contained_in_zh", ZH_CONTAINED)
def _(v):
    return _zh_contained(v)


@query("j10_contained_in_zh_all", ZH_CONTAINED)
def _(v):
    return _zh_contained(v)


@query("j10_match_gold", """select q.question_id, b.item_id, coalesce(contains(a.text, b.text), false) hit from benchmark b
 join (select item_id, item_id question_id from benchmark) q on b.item_id = q.item_id left join documents a on a.doc_id = q.question_id""")
def _(v):
    gold = v("benchmark").select(F.col("item_id").alias("question_id"), "item_id", F.col("text").alias("clause"))
    answers = v("documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("answer_zh"))
    return j.match_gold(answers, gold).select("question_id", "item_id", "hit")


@query("j11_normalize_alias", "select citation_id, " + case_map("asset_in", vocab.ASSET_ALIASES) + " asset_in_norm, " + case_map("asset_in", vocab.ASSET_ALIASES) +
       " is not null asset_in_valid from (select citation_id, lower(trim(case doc_id % 6 when 0 then ' PV ' when 1 then '储能' when 2 then 'Coal' when 3 then 'hydro' else asset end)) asset_in from citation_base)")
def _(v):
    spelled = F.expr("case doc_id % 6 when 0 then ' PV ' when 1 then '储能' when 2 then 'Coal' when 3 then 'hydro' else asset end")
    rows = v("citation_base").select("citation_id", spelled.alias("asset_in"))
    return j.normalize_alias(rows, "asset_in", vocab.ASSET_ALIASES).drop("asset_in")


@query("j12_with_labels", f"select question_id, {case_map('province', vocab.PROVINCE_LABELS)} province_label, coalesce({case_map('asset', vocab.ASSET_LABELS)}, '') asset_label, {case_map('doc_class', vocab.DOC_CLASS_LABELS)} doc_class_label from question_v")
def _(v):
    labels = {"province": vocab.PROVINCE_LABELS, "asset": vocab.ASSET_LABELS, "doc_class": vocab.DOC_CLASS_LABELS}
    return j.with_labels(v("question_v"), labels).select("question_id", "province_label", "asset_label", "doc_class_label")


WORDS_OF = r"(select distinct unnest(regexp_extract_all(lower({c}), '[a-z]+')) {n} from {t})"
DICTIONARY = "(select term from " + WORDS_OF.format(c="text", n="term", t="conversations") + " where length(term) >= 6)"


def _words(df, c, name):
    return df.select(F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))).alias(name)).distinct()


@query("j4_dictionary", f"select doc_id, term, position(term in text) position from documents, {DICTIONARY} where contains(text, term)")
def _(v):
    """Texts and a dictionary table of thousands of terms."""
    return contained_terms(v.dealt("documents"), _words(v("conversations"), "text", "term").filter("length(term) >= 6"), "doc_id", "text")


@query("x13_near_terms", f"""select word, term, <<r:1.0 - levenshtein(word, term) / greatest(length(word), length(term))>> similarity from {WORDS_OF.format(c="text", n="word", t="benchmark")}, {DICTIONARY}
 where 1.0::double - levenshtein(word, term) / greatest(length(word), length(term)) >= 0.8""")
def _(v):
    """Words of the items that a dictionary term is near to."""
    return near_terms(_words(v("benchmark"), "text", "word"), _words(v("conversations"), "text", "term").filter("length(term) >= 6"))
