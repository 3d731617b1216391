"""Queries of the training-data operators over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from regulith.llm.archive import archive_round_trip
from regulith.llm.block_dedup import dedup_windows
from regulith.llm.decontaminate import contaminated
from regulith.llm.lexical import ranked_search
from regulith.llm.line_templates import drop_recurring_lines
from regulith.llm.minhash import near_duplicates
from regulith.llm.mixing import mix_sources
from regulith.llm.negatives import hard_negatives
from regulith.llm.packing import pack_documents
from regulith.llm.perplexity import perplexity_filter
from regulith.llm.quality_rules import quality_rules
from regulith.llm.suffix_dedup import dedup_strings
from regulith.llm.toxicity import score_toxicity
from regulith.session import configure
from regulith.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(table) -> DataFrame``; table(name) reads a whole table."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(lambda table: load(spark, sf_dir, table))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_decontaminate")
def op1(table):
    return contaminated(table("documents"), table("benchmark"))


@query("op2_toxicity")
def op2(table):
    return score_toxicity(table("documents"), table("labels"))


@query("op3_quality_rules")
def op3(table):
    return quality_rules(table("documents"))


STRING_SQL = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
 b as (select doc_id, unnest(range(len(h) // 2)) i, unnest(list_transform(range(len(h) // 2), lambda i: substr(h, 2 * i + 1, 2))) b,
  unnest(list_transform(range(len(h) // 2), lambda i: case when 2 * i + 200 <= len(h) then md5(substr(h, 2 * i + 1, 200)) end)) k from t where h <> ''),
 f as (select *, k is not null and row_number() over (partition by k order by doc_id, i) > 1 again from b),
 c as (select doc_id, i, b, coalesce(max(cast(again as int)) over (partition by doc_id order by i rows between 99 preceding and current row), 0) gone from f),
 e as (select *, gone = 1 and coalesce(lag(gone) over (partition by doc_id order by i), 0) = 0 opens from c)
select t.doc_id, len(t.h) // 2 n_bytes, coalesce(sum(e.gone), 0) n_removed, count(case when e.opens then 1 end) n_spans,
 sha256(unhex(coalesce(string_agg(case when e.gone = 0 then e.b end, '' order by e.i), ''))) kept_sha256
from t left join e on e.doc_id = t.doc_id group by t.doc_id, t.h
"""

WINDOW_SQL = """
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
 b as (select doc_id, unnest(range(len(w))) i, unnest(w) word,
  unnest(list_transform(range(len(w)), lambda i: case when i + 50 <= len(w) then md5(array_to_string(w[i + 1:i + 50], ' ')) end)) k from t where len(w) > 0),
 f as (select *, k is not null and doc_id > min(doc_id) over (partition by k) again from b),
 c as (select doc_id, i, word, coalesce(max(cast(again as int)) over (partition by doc_id order by i rows between 49 preceding and current row), 0) gone from f)
select t.doc_id, len(t.w) n_words, coalesce(sum(c.gone), 0) n_removed, sha256(coalesce(string_agg(case when c.gone = 0 then c.word end, ' ' order by c.i), '')) kept_sha256
from t left join c on c.doc_id = t.doc_id group by t.doc_id, len(t.w)
"""

NEAR_SQL = """
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
 s as (select distinct doc_id, unnest(case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' ')) end) x
  from t where len(w) > 0),
 n as (select doc_id, count(*) n from s group by doc_id),
 p as (select a.doc_id a, b.doc_id b, count(*) m from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
 e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * m >= 85 * (x.n + y.n - m)),
 g as (select a, b from e union all select b, a from e),
 r as (select doc_id, doc_id c from t union select g.b, r.c from r join g on g.a = r.doc_id),
 m as (select doc_id, min(c) c from r group by doc_id)
select m.doc_id, coalesce(n.n, 0) n_shingles, m.c component_id, m.doc_id = m.c kept from m left join n on n.doc_id = m.doc_id
"""


@query("op4_suffix_dedup", STRING_SQL)
def op4(table):
    return dedup_strings(table("documents"), width=100)


@query("op5_packing")
def op5(table):
    return pack_documents(table("documents"))


@query("op6_perplexity")
def op6(table):
    return perplexity_filter(table("documents"), table("labels"))


@query("op7_block_dedup", WINDOW_SQL)
def op7(table):
    return dedup_windows(table("documents"), window=50)


@query("op8_minhash", NEAR_SQL)
def op8(table):
    return near_duplicates(table("documents"), width=3, percent=85)


ARCHIVE_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) h from pages),
 f as (select h, min(page_id) first from p group by h),
 v as (select p.*, f.first, [cast(concat('0x', substr(p.h, 1 + 5 * i, 5)) as bigint) for i in range(8)] g from p join f using (h))
select page_id, n payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(g[1 + k // 4] // [32768, 1024, 32, 1][1 + k % 4] % 32 as bigint), 1) for k in range(32)], '') payload_digest,
 case when first = page_id then 'response' else 'revisit' end record_type,
 case when first = page_id then null else first end refers_to
from v
"""


@query("op9_archive", ARCHIVE_SQL)
def op9(table):
    return archive_round_trip(table("pages"))


LINE_SQL = """
with l0 as (select doc_id, text, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) pos from documents where text is not null),
 l1 as (select *, regexp_replace(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), '[0-9]+', '<*>', 'g') mask from l0),
 l2 as (select *, string_split(mask, ' ') tokens from l1 where mask <> ''),
 l3 as (select *, len(tokens) n, array_to_string(tokens[1:3], ' ') lead from l2),
 s as (select * from l3 where (n, lead) in (select (n, lead) from l3 group by n, lead having min(doc_id) <> max(doc_id))),
 form as (select n, lead, mask, any_value(tokens) tokens, least(3, count(distinct doc_id)) docs from s group by n, lead, mask),
 place as (select n, lead, mask, docs, unnest(range(4, n + 1)) i, unnest(tokens[4:n]) token from form),
 fixed as (select n, lead, i, token from place group by n, lead, i, token having sum(docs) >= 3),
 held as (select n, lead, mask, list(concat(i, ' ', token) order by i) pattern from place join fixed using (n, lead, i, token) group by n, lead, mask having 100 * count(*) >= 60 * (n - 3)),
 l5 as (select s.doc_id, s.pos, s.n, s.lead, pattern, coalesce(chr(10) || array_to_string(pattern, chr(10)), s.mask) own from s left join held using (n, lead, mask)),
 c as (select n, lead, own, any_value(pattern) pattern, min(doc_id) first, count(distinct doc_id) >= 3 recurs from l5 group by n, lead, own),
 less as (select n, lead, own of_own, unnest(list_transform(range(1, len(pattern) + 1), lambda k: array_to_string(list_filter(pattern, lambda p, i: i <> k), chr(10)))) part from c where recurs and pattern is not null),
 near as (select c.n, c.lead, c.own, c.first, less.of_own from c join less on less.n = c.n and less.lead = c.lead and c.own = chr(10) || less.part where not c.recurs and c.pattern is not null),
 g as (select n, lead, own, own of_own, first from c where recurs union all select * from (select n, lead, own, of_own, first from near)),
 t0 as (select n, lead, of_own, min(first) first from g group by n, lead, of_own),
 t as (select distinct g.n, g.lead, g.own, t0.first from g join t0 using (n, lead, of_own)),
 dropped as (select l5.doc_id, l5.pos from l5 join t using (n, lead, own) where l5.doc_id <> t.first),
 kept as (select l0.doc_id, string_agg(l0.line, chr(10) order by l0.pos) text, count(*) n from l0 left join dropped d on d.doc_id = l0.doc_id and d.pos = l0.pos where d.pos is null group by l0.doc_id)
select d.doc_id, d.lang, d.source, case when d.text is null then null else coalesce(k.text, '') end text,
 case when d.text is null then 0 else len(string_split(d.text, chr(10))) end n_lines,
 case when d.text is null then 0 else len(string_split(d.text, chr(10))) - coalesce(k.n, 0) end n_dropped
from documents d left join kept k on k.doc_id = d.doc_id
"""


@query("op10_line_templates", LINE_SQL)
def op10(table):
    return drop_recurring_lines(table("documents")).drop("n_chars")


MIX_SQL = """
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) size from documents),
 s0 as (select source, cast(sum(size) as bigint) source_size from d group by source),
 s1 as (select *, row_number() over (order by source nulls last) - 1 nr from s0),
 s2 as (select *, [5, 2, 1][nr % 3 + 1] weight, 2 * source_size cap from s1),
 lv as (select 0 k, cast(0 as double) level union all
  select k + 1, (1.5 * cast(sum(source_size) as double) - cast(sum(case when cap < weight * level then cap else 0 end) as double)) / sum(case when cap < weight * level then 0 else weight end)
  from lv, s2 where k <= (select count(*) from s2) group by k, level),
 s3 as (select nr, source, source_size, case when cap < weight * level then cast(cap as double) else weight * level end target from s2, (select level from lv order by k desc limit 1)),
 s as (select *, cast(floor(target + 0.5) as bigint) wanted from s3),
 o as (select nr, doc_id, size, row_number() over w - 1 nth, coalesce(sum(size) over (w rows between unbounded preceding and 1 preceding), 0) off
  from d join s on d.source is not distinct from s.source window w as (partition by nr order by md5(cast(doc_id as varchar)), doc_id, size)),
 t as (select nr, source_size, turn, greatest(0, least(source_size, wanted - turn * source_size)) turn_words from s, unnest([0, 1]) u(turn)),
 b as (select *, unnest(range((source_size + 255) // 256)) block from t where turn_words > 0),
 r as (select *, row_number() over (partition by nr, turn order by block >= source_size // 256, md5(concat_ws(':', nr, turn, block)), block) - 1 place from b),
 f as (select nr, turn, block, least(256, turn_words - 256 * place, source_size - 256 * block) words from r),
 p as (select nr, nth, least(least(off + size, (block + 1) * 256) - greatest(off, block * 256), words - (greatest(off, block * 256) - block * 256)) n
  from o join f using (nr) where words > 0 and size > 0 and block between off // 256 and (off + size - 1) // 256),
 g as (select nr, nth, cast(sum(n) as bigint) taken, count(*) spans from p where n > 0 group by nr, nth)
select o.doc_id, o.size, s.source_size, s.target, coalesce(g.taken, 0) taken, coalesce(g.spans, 0) spans from o join s using (nr) left join g using (nr, nth)
"""


@query("op11_mixing", MIX_SQL)
def op11(table):
    return mix_sources(table("documents"))


SEARCH_SQL = """
with b as (select item_id, row_number() over () nr, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) terms from benchmark),
 d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') t from documents),
 st as (select count(*) docs, cast(sum(len(t)) as bigint) terms from d where len(t) > 0),
 q as (select nr, item_id, unnest(terms) term from b),
 tf as (select doc_id, n, term, count(*) tf from (select doc_id, len(t) n, unnest(t) term from d) where term in (select term from q) group by all),
 df as (select term, count(*) df from tf group by term),
 part as (select doc_id, term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) part from tf join df using (term), st),
 hit as (select nr, item_id, doc_id, cast(sum(part) as bigint) score from q join part using (term) group by all having sum(part) > 0)
select item_id, cast(row_number() over (partition by nr order by score desc, doc_id) as int) "rank", doc_id, score from hit qualify "rank" <= 50
"""


@query("op12_lexical_search", SEARCH_SQL)
def op12(table):
    return ranked_search(table("documents"), table("benchmark"))


NEGATIVE_SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 p as (select a.vec_id anchor, a.label own, b.vec_id, b.label, cast(list_inner_product(a.v, b.v) as bigint) s from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
 y as (select anchor, own, vec_id pid, s ps from p where own = label qualify row_number() over (partition by anchor order by s desc, vec_id) <= 5),
 n as (select y.anchor, pid, ps, p.vec_id nid, p.s ns, row_number() over (partition by y.anchor, pid order by p.s desc, p.vec_id) "rank"
  from y join p on p.anchor = y.anchor and p.label <> y.own and 50 * ps <= 100 * s and 100 * s <= 95 * ps)
select anchor anchor_id, pid positive_id, cast("rank" as int) "rank", nid negative_id, ps positive_score, ns negative_score from n where "rank" <= 3
"""


@query("op13_hard_negatives", NEGATIVE_SQL)
def op13(table):
    return hard_negatives(table("embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
