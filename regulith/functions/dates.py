"""Date extraction by rules, as array expressions over whole columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from regulith.functions.text import strip
from regulith.session import col

# A date in Chinese characters.
YMD = r"20\d{2}年\d{1,2}月\d{1,2}日"

# Date patterns in priority order; digits read year, month, day from left to right.
DATE_PATTERNS = [
    YMD,
    rf"自{YMD}起(?:施行|执行|生效|实施)",
    rf"本(?:规则|办法|通知|公告|文件)自{YMD}起(?:施行|执行|生效|实施)",
    r"20\d{2}[-/]\d{1,2}[-/]\d{1,2}",
    rf"(?:发布|公布|颁布|印发)(?:日期|时间)?[：:]{YMD}",
    rf"(?:生效|施行|执行|实施)(?:日期|时间)?[：:]{YMD}",
    r"[粤鲁蒙川](?:能|电|发改)(?:规|函|通|发)〔20\d{2}〕\d+号",
    rf"(?:批准|核准|审批)(?:日期|时间)?[：:]{YMD}",
    rf"(?:会议|委员会)(?:通过|审议|决定)(?:日期|时间)?[：:]{YMD}",
]
YEAR_ONLY = 6  # index of the document-number pattern, which carries only a year
ISSUED = 4  # index of the pattern naming an issue date
# Announced effect, excluded contexts, publication, simple patterns, dates in URLs, words that raise or lower confidence.
CONTEXT_PATTERNS = [
    "自.*?起(?:施行|执行|生效|实施)",
    "本(?:规则|办法|通知|公告|文件).*?起(?:施行|执行|生效|实施)",
    "(?:施行|执行|生效|实施)(?:日期|时间)",
    "有效期.*?至",
    "废止.*?文件",
]
EXCLUDE = "(?:截止|申请|报送|提交|完成).*?日期"
PUBLICATION_PATTERNS = [
    rf"(?:发布|公布|颁布|印发|批准|核准|审批)(?:日期|时间)?[：:]{YMD}",
    rf"{YMD}(?:发布|公布|颁布|印发|批准|核准|审批)",
]
SIMPLE_PATTERNS = [
    r"\d{4}年\d{1,2}月\d{1,2}日", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{4}/\d{1,2}/\d{1,2}", r"\d{4}\.\d{1,2}\.\d{1,2}",
    r"自\d{4}年\d{1,2}月\d{1,2}日起", r"发布日期[：:]\d{4}-\d{1,2}-\d{1,2}", r"生效日期[：:]\d{4}-\d{1,2}-\d{1,2}",
]
URL_SPLIT_PATTERNS = [r"/(\d{4})/(\d{1,2})/(\d{1,2})/", r"/(\d{4})(\d{2})(\d{2})/", r"_(\d{4})(\d{2})(\d{2})_",
                      r"-(\d{4})(\d{2})(\d{2})-", r"(\d{4})-(\d{1,2})-(\d{1,2})"]
HIGH_CONFIDENCE = "施行|执行|生效|实施|发布|公布|颁布"
LOW_CONFIDENCE = "截止|申请|报送|提交|完成|到期"


def _date(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def _from_digits(match: Column, year_only: bool = False) -> Column:
    digits = F.regexp_extract_all(match, F.lit(r"(\d+)"), 1)
    year = F.get(digits, F.lit(0))
    if year_only:
        return _date(year, F.lit("1"), F.lit("1"))
    return F.when(F.size(digits) >= 3, _date(year, F.get(digits, F.lit(1)), F.get(digits, F.lit(2))))


def _reader(pattern: int):
    """Date of a match of the given pattern, as a one-argument function for array transforms."""
    return lambda match: _from_digits(match, pattern == YEAR_ONLY)


def _first_match_date(c: Column, pattern: str) -> Column:
    return _from_digits(F.regexp_extract(c, pattern, 0))


def reasonable(d: Column, as_of: dt.date) -> Column:
    """Between 2000 and the end of the tenth year after ``as_of``."""
    return (d >= F.lit(dt.date(2000, 1, 1))) & (d <= F.lit(dt.date(as_of.year + 10, 12, 31)))


def parse_zh_date(c: Column | str) -> Column:
    return F.coalesce(*[_first_match_date(col(c), p) for p in SIMPLE_PATTERNS[:3]])


def potential_date(url: Column | str, title: Column | str) -> Column:
    content = F.concat_ws(" ", col(url), F.coalesce(col(title), F.lit("")))
    order = [SIMPLE_PATTERNS[1], SIMPLE_PATTERNS[0], SIMPLE_PATTERNS[2]]
    return F.coalesce(*[F.nullif(F.regexp_extract(content, p, 0), F.lit("")) for p in order])


def date_from_url(c: Column | str, as_of: dt.date) -> Column:
    c = col(c)
    found = []
    for p in URL_SPLIT_PATTERNS:
        d = _date(*[F.regexp_extract(c, p, i) for i in (1, 2, 3)])
        found.append(F.when(reasonable(d, as_of), d))
    return F.coalesce(*found)


def effective_date_simple(text: Column | str, url: Column | str, as_of: dt.date) -> Column:
    """First pattern whose first match is a real date not after ``as_of``."""
    content = F.concat_ws(" ", col(text), col(url))
    found = [_first_match_date(content, p) for p in SIMPLE_PATTERNS]
    return F.coalesce(*[F.when(d <= F.lit(as_of), d) for d in found])


def matches_at(text: Column, pattern: str) -> Column:
    """Non-overlapping matches with their 1-based start: array<struct<m string, at int>>.

    ``split`` and ``regexp_extract_all`` walk the same matches, so the start of a match is the
    length of everything before it.
    """
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    empty = F.array().cast("array<struct<m:string,at:int>>")
    state = F.aggregate(
        F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), found.alias("m")),
        F.struct(F.lit(1).alias("next"), empty.alias("out")),
        lambda s, x: F.struct(
            (s["next"] + x["gap"] + F.length(x["m"])).alias("next"),
            F.concat(s["out"], F.array(F.struct(x["m"].alias("m"), (s["next"] + x["gap"]).alias("at")))).alias("out"),
        ),
    )
    return F.when(text.rlike(pattern), state["out"]).otherwise(empty)


def around(text: Column, match: Column, width: int) -> Column:
    start = F.greatest(F.lit(1), match["at"] - width)
    end = F.least(F.length(text), match["at"] - 1 + F.length(match["m"]) + width)
    return F.substring(text, start, end - start + 1)


def _dates_in(window: Column, as_of: dt.date) -> Column:
    """All reasonable dates of a short text, in pattern order."""
    per_pattern = [
        F.transform(F.regexp_extract_all(window, F.lit(f"({p})"), 1), _reader(i))
        for i, p in enumerate(DATE_PATTERNS)
    ]
    return F.filter(F.flatten(F.array(*per_pattern)), lambda d: reasonable(d, as_of))


def context_date(text: Column, as_of: dt.date) -> Column:
    """Tier 1: the first date within 100 characters of a phrase that announces effect."""
    windows = F.concat(
        *[F.transform(matches_at(text, p), lambda m: around(text, m, 100)) for p in CONTEXT_PATTERNS]
    )
    firsts = F.transform(windows, lambda w: F.try_element_at(_dates_in(w, as_of), F.lit(1)))
    return F.try_element_at(F.filter(firsts, lambda d: d.isNotNull()), F.lit(1))


def publication_date(text: Column, as_of: dt.date) -> Column:
    """Tier 3: issue or approval dates."""
    found = []
    for p in PUBLICATION_PATTERNS:
        dates = F.transform(F.regexp_extract_all(text, F.lit(f"({p})"), 1), lambda m: _from_digits(m))
        found.append(F.try_element_at(F.filter(dates, lambda d: reasonable(d, as_of)), F.lit(1)))
    return F.coalesce(*found)


def _place(top: Column, read, rank: Column):
    return lambda m: F.struct(
        m["at"].alias("at"), rank.alias("rank"), read(m["m"]).alias("d"), around(top, m, 50).rlike(EXCLUDE).alias("excluded"))


def first_date(text: Column, as_of: dt.date, head: int | None = None) -> Column:
    """Tier 4: the earliest date of the text, or of its first ``head`` characters, that no excluding phrase surrounds."""
    top = text if head is None else F.substring(text, 1, head)
    candidates = []
    for i, p in enumerate(DATE_PATTERNS):
        read, rank = _reader(i), F.lit(i)
        rows = F.transform(matches_at(top, p), _place(top, read, rank))
        candidates.append(F.filter(rows, lambda r: reasonable(r["d"], as_of) & ~r["excluded"]))
    return F.array_min(F.concat(*candidates))["d"]


def _hit(text: Column, pattern: int):
    """Date, context and confidence of one match of the given pattern."""
    read = _reader(pattern)

    def row(m):
        context = strip(around(text, m, 30))
        before, n = m["at"] - 1, F.length(text)
        place = F.when(before < n * 0.1, 0.2).when(before < n * 0.3, 0.1).otherwise(0.0)
        score = (
            F.lit(0.8 if pattern == ISSUED else 0.5) + place
            + F.when(context.rlike(HIGH_CONFIDENCE), 0.1).otherwise(0.0)
            - F.when(context.rlike(LOW_CONFIDENCE), 0.3).otherwise(0.0)
        )
        return F.struct(
            read(m["m"]).alias("d"), context.alias("context"),
            F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6).alias("confidence"),
            F.lit(pattern).alias("rank"), m["at"].alias("at"),
        )

    return row


def date_hits(text: Column | str, as_of: dt.date) -> Column:
    """All dates with context and confidence: array<struct<d, context, confidence, rank, at>>."""
    text = col(text)
    hits = []
    for i, p in enumerate(DATE_PATTERNS):
        hits.append(F.filter(F.transform(matches_at(text, p), _hit(text, i)), lambda r: reasonable(r["d"], as_of)))
    return F.concat(*hits)


def cadence_hours(c: Column | str) -> Column:
    """Hours of a repeating ISO interval; the start part is ignored, 24 without an interval."""
    c = F.regexp_extract(col(c), r"(P(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+S)?)?)", 1)
    part = lambda p: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, p, 1), F.lit("")), F.lit("999999")).cast("double"), F.lit(0.0))
    hours = part(r"P(\d+)D") * 24 + part(r"(\d+)H") + part(r"T(?:\d+H)?(\d+)M") / 60 + part(r"(\d+)S") / 3600
    return F.when(F.length(c) == 0, F.lit(24)).otherwise(F.greatest(F.lit(1), F.floor(hours).cast("int")))


def next_crawl(last: Column | str, cadence: Column | str) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(col(last)) + cadence_hours(cadence) * 3600)
