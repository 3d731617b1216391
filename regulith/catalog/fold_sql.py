"""SQL for texts cut into paragraphs, clauses and chunks, and for dates with their places: the look-around patterns of the
operators as marks that are then split, their folds as ``list_reduce``."""

from __future__ import annotations

from regulith.catalog.scalar import RATIO, strip_sql, tokens_sql, url_date_sql
from regulith.functions import dates as d
from regulith.functions.text import CJK_NUMERALS, FULL_WIDTH, HALF_WIDTH

MARK = "chr(1)"
NL = "chr(10)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, {quoted(pattern)}, {to if to.startswith('chr') else quoted(to)}, 'g')"


def normalized(c: str) -> str:
    """Gaps between characters are closed by two passes over pairs, as a pass takes both characters of a pair."""
    c = f"translate({c}, '　 ', '  ')"
    c = sub(sub(c, r"[ \t\r\f\v]+", " "), r"\n{3,}", "chr(10) || chr(10)")
    rules = sub("t", r"\s*([。！？；：])\s*", r"\1")
    rules = f"translate({rules}, {quoted(FULL_WIDTH)}, {quoted(HALF_WIDTH)})"
    for _ in range(2):
        rules = sub(rules, r"([一-龯])\s+([一-龯])", r"\1\2")
    rules = sub(sub(rules, r"([0-9])\s+([年月日])", r"\1\2"), r"([年月])\s+([0-9])", r"\1\2")
    rules = sub(rules, rf"第\s*([{CJK_NUMERALS}]+)\s*条", r"第\1条")
    rules = f"translate({rules}, '“”‘’', '\"\"''''')"
    body = rf"case when regexp_matches(t, '[\x{{2018}}-\x{{ffff}}]') then {rules} else t end"
    return f"coalesce([{strip_sql('u')} for u in [{body} for t in [{c}]]][1], '')"


def keep(parts: str) -> str:
    return f"list_filter([{normalized('p')} for p in {parts}], lambda p: length(p) > 10)"


def paragraphs(table: str, lines_where: str = "false") -> str:
    """(doc_id, url, text, paragraphs) of a table with doc_id, url, text; lines are blocks where ``lines_where``."""
    lines = f"string_split(text, {NL})"
    grouped = f"array_to_string([{strip_sql('p')} for p in {lines}], {NL})"
    groups = f"[replace({strip_sql('g')}, {NL}, ' ') for g in string_split_regex({grouped}, '\\n\\n+')]"
    return f"""(select doc_id, url, text, case when len(b) > 0 then b when len(f) > 0 then f else g end paragraphs
 from (select doc_id, url, text, case when {lines_where} then {keep(lines)} else [] end b, {keep(f"string_split(text, {NL} || {NL})")} f, {keep(groups)} g from {table}))"""


# A clause marker gets a mark in front; \1 is the marker with what must follow it.
CLAUSE_MARKS = [
    r"(第[一二三四五六七八九十百千万]+条)", r"([（(][一二三四五六七八九十百千万\d]+[）)])", r"(\d+[.、])", r"([。！？；])",
    r"([：:]\s*[（(一二三四五六七八九十\d])", r"(同时|另外|此外|其中|包括|具体|特别|尤其)",
]


def clauses(paras: str, least: int) -> str:
    parts = paras
    for pattern in CLAUSE_MARKS:
        cut = f"string_split(regexp_replace(p, {quoted(pattern)}, chr(1) || '\\1', 'g'), chr(1))"
        parts = f"list_filter(flatten([[{strip_sql('x')} for x in {cut}] for p in {parts}]), lambda p: length(p) > 0)"
    return f"list_filter({parts}, lambda p: length(p) >= {least})"


def chunks(table: str, max_tokens: int, overlap: int, min_clause: int, min_chunk: int = 50) -> str:
    """CTEs ``packed`` (doc_id, full, ks: list of {cs, t}) and ``chunk`` (one row a chunk) of a table with doc_id, paragraphs."""
    empty = "[]::struct(c varchar, t bigint)[]"
    none = "[]::struct(cs varchar[], t bigint)[]"
    state = f"{{'c': '', 't': 0::bigint, 'done': {none}, 'cur': {empty}, 'tok': 0::bigint}}"
    item = f"{{'c': x, 't': {tokens_sql('x')}, 'done': {none}, 'cur': {empty}, 'tok': 0::bigint}}"
    close = "{'cs': [k.c for k in s.cur], 't': s.tok}"
    # How many of the last clauses fit into the overlap: their tokens are at least one each, so the sums rise.
    last = f"list_max([m for m in range(0, len(s.cur) + 1) if m = 0 or list_sum([k.t for k in s.cur[len(s.cur) - m + 1:]]) <= {overlap}])"
    kept = f"case when {last} = 0 then {empty} else s.cur[len(s.cur) - {last} + 1:] end"
    me = "[{'c': x.c, 't': x.t}]"
    kept_tokens = "coalesce(list_sum([k.t for k in o]), 0)"
    reopened = f"""[case when {kept_tokens} + x.t <= {max_tokens} then {{'c': '', 't': 0::bigint, 'done': list_concat(s.done, [{close}]), 'cur': list_concat(o, {me}), 'tok': ({kept_tokens} + x.t)::bigint}}
   else {{'c': '', 't': 0::bigint, 'done': list_concat(s.done, [{close}]), 'cur': {me}, 'tok': x.t}} end for o in [{kept}]][1]"""
    step = f"""case when s.tok + x.t > {max_tokens} and len(s.cur) > 0 then {reopened}
  else {{'c': '', 't': 0::bigint, 'done': s.done, 'cur': list_concat(s.cur, {me}), 'tok': s.tok + x.t}} end"""
    held0 = f"{{'cs': []::varchar[], 't': 0::bigint, 'out': {none}, 'held': {none}}}"
    held_item = f"{{'cs': k.cs, 't': k.t, 'out': {none}, 'held': {none}}}"
    one = "[{'cs': x.cs, 't': x.t}]"
    merge = f"""case when len(s.held) = 0 then {{'cs': []::varchar[], 't': 0::bigint, 'out': s.out, 'held': {one}}}
  when s.held[1].t < {min_chunk} and s.held[1].t + x.t <= {max_tokens} then {{'cs': []::varchar[], 't': 0::bigint, 'out': list_concat(s.out, [{{'cs': list_concat(s.held[1].cs, x.cs), 't': s.held[1].t + x.t}}]), 'held': {none}}}
  else {{'cs': []::varchar[], 't': 0::bigint, 'out': list_concat(s.out, s.held), 'held': {one}}} end"""
    return f"""cl as (select doc_id, array_to_string(paragraphs, {NL}) full_text, {clauses('paragraphs', min_clause)} c from {table}),
 f1 as (select doc_id, full_text, list_reduce(list_concat([{state}], [{item} for x in c]), lambda s, x: {step}) s from cl),
 f2 as (select doc_id, full_text, case when len(s.cur) > 0 then list_concat(s.done, [{close}]) else s.done end ks from f1),
 f3 as (select doc_id, full_text, list_reduce(list_concat([{held0}], [{held_item} for k in ks]), lambda s, x: {merge}) s from f2),
 packed as (select doc_id, full_text, list_concat(s.out, s.held) ks from f3),
 chunk as (select doc_id, pos, array_to_string(k.cs, {NL}) content, k.t token_count, greatest(position(k.cs[1] in full_text) - 1, 0) start_char
  from (select doc_id, full_text, unnest(ks) k, unnest(range(0, len(ks))) pos from packed))"""


def merged_short(parts: str, least: int = 50) -> str:
    """Parts in one string with marks between the finished ones; an empty last part is taken over."""
    last = "string_split(s, chr(1))[-1]"
    step = f"case when length({last}) between 1 and {least - 1} then s || {NL} || x when length({last}) = 0 then s || x else s || chr(1) || x end"
    return f"list_filter(string_split(list_reduce({parts}, lambda s, x: {step}), chr(1)), lambda p: length(p) > 0)"


# Dates with their places.
RANGE = "between date '2000-01-01' and date '2036-12-31'"


def date_of(m: str, rank: str) -> str:
    n = [f"regexp_extract_all({m}, '[0-9]+')[{i}]" for i in (1, 2, 3)]
    full = f"try_cast(lpad({n[0]}, 4, '0') || '-' || lpad({n[1]}, 2, '0') || '-' || lpad({n[2]}, 2, '0') as date)"
    return f"case when {rank} = {d.YEAR_ONLY} then try_cast(lpad({n[0]}, 4, '0') || '-01-01' as date) else {full} end"


def places(name: str, source: str, patterns: list[str]) -> str:
    """CTE of all matches: doc_id, text, rank (of the pattern), k, m, at (from 1)."""
    rows = " union all ".join(
        f"select doc_id, text, {i} rank, regexp_extract_all(text, {quoted(p)}) ms, string_split_regex(text, {quoted(p)}) gaps from {source}" for i, p in enumerate(patterns))
    return f"""{name} as (select doc_id, text, rank, k, ms[k] m, cast(1 + list_sum([length(g) for g in gaps[1:k]]) + coalesce(list_sum([length(x) for x in ms[1:k - 1]]), 0) as bigint) "at"
  from (select *, unnest(range(1, len(ms) + 1)) k from ({rows})))"""


def window(width: int) -> str:
    low = f'greatest(1, "at" - {width})'
    return f'substr(text, {low}, least(length(text), "at" - 1 + length(m) + {width}) - {low} + 1)'


def dates(source: str) -> str:
    """CTEs over a table with doc_id, text, url: ``hit`` (every date with context and confidence), ``dd`` (the effective date)."""
    context = " union all ".join(f"select doc_id, rank p, k, {i} i, unnest(regexp_extract_all(w, {quoted(x)})) m, unnest(range(1, len(regexp_extract_all(w, {quoted(x)})) + 1)) j from (select *, {window(100)} w from ctx)" for i, x in enumerate(d.DATE_PATTERNS))
    score = f"""(case when rank = {d.ISSUED} then 0.8e0 else 0.5e0 end + case when "at" - 1 < length(text) * 0.1e0 then 0.2e0 when "at" - 1 < length(text) * 0.3e0 then 0.1e0 else 0e0 end
   + case when regexp_matches(context, '{d.HIGH_CONFIDENCE}') then 0.1e0 else 0e0 end - case when regexp_matches(context, '{d.LOW_CONFIDENCE}') then 0.3e0 else 0e0 end)"""
    return f"""src as (select doc_id, text, url from {source}),
 {places('ctx', 'src', d.CONTEXT_PATTERNS)},
 ctxd as (select doc_id, arg_min(dd, (p, k, i, j)) dd from (select *, {date_of('m', 'i')} dd from ({context})) where dd {RANGE} group by doc_id),
 {places('pub', 'src', d.PUBLICATION_PATTERNS)},
 pubd as (select doc_id, arg_min(dd, (rank, k)) dd from (select *, {date_of('m', '0')} dd from pub) where dd {RANGE} group by doc_id),
 {places('found', 'src', d.DATE_PATTERNS)},
 hit as (select *, round(least(1e0, greatest(0e0, {score})), 6) confidence from (select *, {date_of('m', 'rank')} dd, {strip_sql(window(30))} context, regexp_matches({window(50)}, '{d.EXCLUDE}') excluded from found) where dd {RANGE}),
 firstd as (select doc_id, arg_min(dd, ("at", rank, dd)) dd from hit where not excluded group by doc_id),
 dd as (select src.doc_id, coalesce(ctxd.dd, {url_date_sql('url')}, pubd.dd, firstd.dd) dd from src left join ctxd using (doc_id) left join pubd using (doc_id) left join firstd using (doc_id))"""


def language(c: str) -> str:
    ratio = RATIO.replace("content", c)
    return f"case when {ratio} is null then null when {ratio} >= 0.3 then 'zh-CN' when {ratio} >= 0.1 then 'zh-mixed' else 'other' end"


def text_chunks(table: str, max_tokens: int, overlap: int) -> str:
    """CTE ``piece``: doc_id, pos, text, tokens, before (lengths of the earlier chunks) of the paragraph variant."""
    cjk = lambda c: f"len(regexp_extract_all({c}, '[\\x{{4e00}}-\\x{{9fff}}]'))"
    tokens = lambda c: f"cast(floor({cjk(c)} * 1.5e0 + (length({c}) - {cjk(c)}) * 0.5e0) as bigint)"
    none = "[]::struct(text varchar, tokens bigint)[]"
    state = lambda c, t, glue, done, cur, tok: f"{{'c': {c}, 't': {t}, 'glue': {glue}, 'done': {done}, 'cur': {cur}, 'tok': {tok}}}"
    unit = lambda c, glue: state(c, tokens(c), glue, none, "''", "0::bigint")
    paras = f"list_filter([{strip_sql('p')} for p in string_split(text, {NL} || {NL})], lambda p: length(p) > 0)"
    sentences = f"list_filter([{strip_sql('x')} for x in string_split_regex(p, '[。！？；]')], lambda x: length(x) > 0)"
    units = f"flatten([case when {tokens('p')} > {max_tokens} then [{unit('y', chr(39) * 2)} for y in {sentences}] else [{unit('p', f'{NL} || {NL}')}] end for p in {paras}])"
    again = f"right(s.cur, {overlap}) || x.glue || x.c"
    step = f"""case when s.tok + x.t > {max_tokens} and length(s.cur) > 0
   then {state("''", '0::bigint', "''", "list_concat(s.done, [{'text': s.cur, 'tokens': s.tok}])", again, tokens(f'({again})'))}
   else {state("''", '0::bigint', "''", 's.done', "case when length(s.cur) > 0 then s.cur || x.glue || x.c else x.c end", 's.tok + x.t')} end"""
    start = state("''", "0::bigint", "''", none, "''", "0::bigint")
    return f"""t1 as (select doc_id, list_reduce(list_concat([{start}], {units}), lambda s, x: {step}) s from {table}),
 t2 as (select doc_id, case when length({strip_sql('s.cur')}) > 0 then list_concat(s.done, [{{'text': s.cur, 'tokens': s.tok}}]) else s.done end ks from t1),
 piece as (select doc_id, pos, k.text as "text", k.tokens tokens, coalesce(sum(length({strip_sql('k.text')})) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) before
  from (select doc_id, unnest(ks) k, unnest(range(0, len(ks))) pos from t2))"""
