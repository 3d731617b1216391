"""Text helpers: normalisation, truncation, passages, token estimates, language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regulith.session import bind, col

# Character classes used by the text rules.
CJK = r"[\x{4e00}-\x{9fff}]"
ALNUM = r"[\p{L}\p{N}]"
WORD = r"[\p{L}\p{N}_]+"
PUNCTUATION = r"""[，。！？；：“”‘’（）【】《》、.,!?;:"'()\[\]<>]"""
QUERY_PUNCTUATION = r"[？?！!。.，,；;：:]"
SENTENCE_END = "[。！？]"
KEPT_MARKS = "，！？；：（）"  # CJK punctuation that later rules look for stays full width
FULL_WIDTH = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F) if chr(c + 0xFEE0) not in KEPT_MARKS)
HALF_WIDTH = "".join(chr(ord(c) - 0xFEE0) for c in FULL_WIDTH)
CJK_NUMERALS = "一二三四五六七八九十百千万"
UNITS = "千瓦|兆瓦|万千瓦|千伏|万伏|千米|公里|米|厘米|毫米|吨|千克|公斤|克|升|毫升|小时|分钟|秒|年|月|日|天"


def strip(c: Column | str) -> Column:
    """Remove white space at both ends (``trim`` alone only removes blanks); only the ends are looked at."""
    return F.btrim(col(c), F.lit(" \t\n\x0b\f\r"))


def count_matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def count_literal(c: Column | str, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal string."""
    c = col(c)
    removed = F.length(c) - F.length(F.replace(c, needle, F.lit("")))
    return F.when(F.length(needle) > 0, F.floor(removed / F.length(needle))).otherwise(F.lit(0))


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def md5_hex(c: Column | str) -> Column:
    return F.md5(col(c))


def stable_id(url: Column | str, checksum: Column | str) -> Column:
    """Deterministic UUID-shaped id: the first 16 bytes of sha256('url:checksum')."""
    digest = F.substring(F.sha2(F.concat_ws(":", col(url), col(checksum)), 256), 1, 32)
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def squeeze_ws(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def truncate(c: Column | str, n: int, suffix: str = "") -> Column:
    c = col(c)
    cut = F.concat(F.substring(c, 1, n - len(suffix)), F.lit(suffix))
    return F.when(F.length(c) <= n, c).otherwise(cut)


def strip_punct(c: Column | str) -> Column:
    return F.regexp_replace(col(c), PUNCTUATION, "")


def passage(c: Column | str, n: int = 500) -> Column:
    """At most ``n`` characters, cut after the last sentence end, else with '...'."""
    c = col(c)
    head = F.substring(c, 1, n)
    # A boundary at the very first character does not count as a cut.
    sentence = F.regexp_extract(head, "(?s)^.+[。！？]", 0)
    return (
        F.when(c.isNull(), F.lit(""))
        .when(F.length(c) <= n, c)
        .when(F.length(sentence) > 0, sentence)
        .otherwise(F.concat(head, F.lit("...")))
    )


def key_clause(c: Column | str) -> Column:
    cleaned = strip(c)
    first = F.element_at(F.split(cleaned, SENTENCE_END), 1)
    return (
        F.when(col(c).isNull() | (F.length(col(c)) == 0), F.lit("相关规定"))
        .when(F.length(cleaned) <= 100, cleaned)
        .when(F.length(first) <= 150, F.concat(first, F.lit("。")))
        .when(F.length(cleaned) > 150, F.concat(F.substring(cleaned, 1, 147), F.lit("...")))
        .otherwise(cleaned)
    )


def quote_first(c: Column | str) -> Column:
    """The first two non-empty segments between '。' and line breaks, joined by '；'."""
    parts = F.transform(F.split(col(c), "[。\n]"), strip)
    return F.array_join(F.slice(F.filter(parts, lambda p: F.length(p) > 0), 1, 2), "；")


def first_line_title(c: Column | str, max_len: int = 200) -> Column:
    lines = F.transform(F.split(col(c), "\n"), strip)
    long_lines = F.filter(lines, lambda line: F.length(line) > 10)
    return F.substring(F.try_element_at(long_lines, F.lit(1)), 1, max_len)


def token_estimate(c: Column | str, mode: str = "words") -> Column:
    """``words``: 1.5 CJK + 1.3 words + 0.5 blanks, at least 1. ``chars``: 1.5 CJK + 0.5 rest."""
    c = col(c)
    cjk = count_matches(c, CJK)
    if mode == "chars":
        return (cjk * 1.5 + (F.length(c) - cjk) * 0.5).cast("int")
    # A CJK character ends a word, and so does its removal only where the two
    # neighbours are both word characters; those neighbours then form one word.
    # Texts of plain bytes have no CJK, and their letters and digits are those of \w: cheaper patterns tell the same.
    bare = F.octet_length(c) == F.length(c)
    cjk = F.when(bare, F.lit(0)).otherwise(cjk)
    words = F.when(bare, count_matches(c, r"\w+")).otherwise(count_matches(F.regexp_replace(c, CJK, ""), WORD))
    blanks = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    estimate = (cjk * 1.5 + words * 1.3 + blanks * 0.5).cast("int")
    return F.when(c.isNull() | (F.length(c) == 0), F.lit(0)).otherwise(F.greatest(F.lit(1), estimate))


def cjk_ratio(c: Column | str) -> Column:
    """Share of CJK characters among letters and digits; NULL without any."""
    c = col(c)
    return F.try_divide(count_matches(c, CJK).cast("double"), count_matches(c, ALNUM))


def has_cjk(c: Column | str, min_ratio: float | None = 0.3) -> Column:
    """``min_ratio=None`` asks for any CJK character at all."""
    if min_ratio is None:
        return F.coalesce(col(c).rlike(CJK), F.lit(False))
    return F.coalesce(cjk_ratio(c) >= min_ratio, F.lit(False))


def language_label(c: Column | str) -> Column:
    ratio = cjk_ratio(c)
    return (
        F.when(ratio.isNull(), F.lit(None).cast("string"))
        .when(ratio >= 0.3, "zh-CN")
        .when(ratio >= 0.1, "zh-mixed")
        .otherwise("other")
    )


def normalize_cjk(c: Column | str) -> Column:
    """White-space, punctuation and width rules for CJK text coming out of layout analysis.

    Blanks around sentence marks go first, then full-width letters, digits and signs are folded to
    half width; look-around closes every gap between CJK characters and inside dates.
    """
    c = F.translate(col(c), "\u3000\u00a0", "  ")
    c = F.regexp_replace(c, r"[ \t\r\f\x0B]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    # Text without any character from U+2018 on has nothing for the remaining rules: one test instead of seven passes.
    return F.coalesce(strip(bind(c, lambda t: F.when(t.rlike(r"[\x{2018}-\x{ffff}]"), _cjk_rules(t)).otherwise(t))), F.lit(""))


def _cjk_rules(c: Column) -> Column:
    c = F.regexp_replace(c, r"\s*([。！？；：])\s*", "$1")
    c = F.translate(c, FULL_WIDTH, HALF_WIDTH)
    c = F.regexp_replace(c, r"(?<=[一-龯])\s+(?=[一-龯])", "")
    c = F.regexp_replace(c, r"(?<=[0-9])\s+(?=[年月日])|(?<=[年月])\s+(?=[0-9])", "")
    c = F.regexp_replace(c, rf"第\s*([{CJK_NUMERALS}]+)\s*条", "第$1条")
    return F.translate(c, "“”‘’", "\"\"''")


def clean_ocr(c: Column | str, keep_basic: bool = False) -> Column:
    """Remove bars and boxes, close number-unit gaps, repair O/l/S between digits."""
    c = F.translate(col(c), "|｜□■▪▫", "")
    if keep_basic:
        c = F.regexp_replace(c, r"""[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\p{L}\p{N}_\s.,;:!?()\[\]{}"'。，；：！？（）—–-]""", "")
    c = F.regexp_replace(c, rf"(\d+)\s*({UNITS})", "$1$2")
    for wrong, right in (("O", "0"), ("l", "1"), ("S", "5")):
        c = F.regexp_replace(c, rf"(\d){wrong}(\d)", "$1" + right + "$2")
    return c


def mask_middle(c: Column | str, keep: int = 4) -> Column:
    c = col(c)
    n = F.length(c)
    middle = F.repeat(F.lit("*"), n - 2 * keep)
    return (
        F.when(c.isNull(), F.lit(""))
        .when(n <= 2 * keep, F.repeat(F.lit("*"), n))
        .otherwise(F.concat(F.left(c, F.lit(keep)), middle, F.right(c, F.lit(keep))))
    )


def snippet_around(text: Column | str, needle: Column | str, width: int = 200, max_len: int = 300) -> Column:
    """Context of the first occurrence of ``needle``; NULL where it does not occur."""
    text, needle = col(text), col(needle)
    at = F.position(needle, text)
    start = F.greatest(F.lit(1), at - width)
    end = F.least(F.length(text), at - 1 + F.length(needle) + width)
    context = squeeze_ws(F.substring(text, start, end - start + 1))
    cut = F.when(F.length(context) > max_len, F.concat(F.substring(context, 1, max_len), F.lit("..."))).otherwise(context)
    return F.when(at > 0, cut)


def fingerprint(province, asset, doc_class, question, variant: str = "raw") -> Column:
    """Query fingerprint. ``raw``: lower-cased question; ``clean``: white space collapsed and
    punctuation dropped (callers pass alias-normalised keys); ``short``: 16 hex characters."""
    province, asset, doc_class, question = col(province), col(asset), col(doc_class), col(question)
    if variant == "raw":
        return F.sha2(F.concat_ws(":", province, asset, doc_class, F.lower(strip(question))), 256)
    if variant == "clean":
        cleaned = F.regexp_replace(F.regexp_replace(F.lower(strip(question)), r"\s+", " "), QUERY_PUNCTUATION, "")
        return F.sha2(F.concat_ws(":", province, asset, doc_class, cleaned), 256)
    if variant == "short":
        body = F.concat_ws(":", province, doc_class, F.coalesce(asset, F.lit("none")), F.lower(strip(question)))
        return F.substring(F.sha2(body, 256), 1, 16)
    raise ValueError(f"unknown fingerprint variant: {variant}")


HAN = r"\u4e00-\u9fff"


def simple_tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscore; runs of Chinese characters give their pairs (one alone stays)."""
    text = F.lower(col(c))
    other = rf"(?:(?![{HAN}])[\p{{L}}\p{{N}}_])"
    apart = F.regexp_replace(text, rf"(?<=[{HAN}])(?={other})|(?<={other})(?=[{HAN}])", " ")
    pairs = F.regexp_replace(apart, rf"([{HAN}])(?=([{HAN}]))", "$1$2 ")
    pairs = F.regexp_replace(pairs, rf"(?<=[{HAN}]{{2}} )[{HAN}](?![{HAN}])", " ")
    return F.regexp_extract_all(F.when(text.rlike(f"[{HAN}]"), pairs).otherwise(text), F.lit(f"({WORD})"), 1)


def parameter_values(c: Column | str) -> Column:
    """Numbers with units: map of parameter type to the values found, in text order."""
    c = col(c)
    # Unit patterns per parameter type.
    patterns = {
        "capacity": r"(?i)(\d+(?:\.\d+)?)\s*(?:MW|兆瓦|千瓦|KW)",
        "voltage": r"(?i)(\d+(?:\.\d+)?)\s*(?:KV|千伏|伏)",
        "percentage": r"(\d+(?:\.\d+)?)\s*%",
        "timeline": r"(?i)(\d+)\s*(?:天|日|月|年|days?|months?|years?)",
    }
    found = F.create_map(
        *[x for name, p in patterns.items() for x in (F.lit(name), F.regexp_extract_all(c, F.lit(p), 1))]
    )
    return F.map_filter(found, lambda _, values: F.size(values) > 0)
