"""Scores: relevance, confidence, similarity of short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regulith.functions.text import count_literal
from regulith.functions.urls import url_host
from regulith.session import col

# Term lists used by the scores.
ENERGY_TERMS = ["能源", "电力", "光伏", "风电", "储能", "并网", "调度", "市场", "交易"]
DISCOVERY_TERMS = ["规则", "办法", "管理", "规定", "通知", "公告", "电力", "能源", "交易", "并网", "调度", "市场"]
PROVINCE_TERMS = {"guangdong": ["广东", "粤"], "shandong": ["山东", "鲁"], "inner_mongolia": ["内蒙古", "蒙"]}
CUE_WORDS = ["办法", "规定", "通知", "意见", "细则", "指南", "并网", "接入", "审批", "许可", "招标", "公告"]


def any_of(c: Column, words: list[str]) -> Column:
    """Does the text contain any of the words: one regular expression, one pass."""
    return c.rlike("|".join(words))


def term_hits(c: Column, words: list[str]) -> Column:
    return sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))


def words_of(c: Column | str) -> Column:
    parts = F.split(F.lower(col(c)), r"\s+")
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) > 0))


def jaccard_words(a: Column | str, b: Column | str) -> Column:
    left, right = words_of(a), words_of(b)
    both = F.size(F.array_intersect(left, right)).cast("double")
    return F.coalesce(F.try_divide(both, F.size(F.array_union(left, right))), F.lit(0.0))


def relevance(link, title, snippet, orig_url, orig_title) -> Column:
    link, title, snippet, orig_url, orig_title = map(col, (link, title, snippet, orig_url, orig_title))
    url_part = (
        F.when(link == orig_url, 0.5)
        .when(F.contains(link, orig_url) | F.contains(orig_url, link), 0.3)
        .when(url_host(link) == url_host(orig_url), 0.2)
        .otherwise(0.0)
    )
    snippet_part = F.least(term_hits(F.lower(F.coalesce(snippet, F.lit(""))), ENERGY_TERMS) * 0.02, F.lit(0.2))
    return F.least(url_part + F.coalesce(jaccard_words(title, orig_title), F.lit(0.0)) * 0.3 + snippet_part, F.lit(1.0))


def combined_confidence(status, discovery, verification) -> Column:
    return F.when(col(status) == "verified", col(discovery) * 0.3 + col(verification) * 0.7).otherwise(F.lit(0.0))


def discovery_confidence(title, url, domain, province, allowlist: list[str]) -> Column:
    """0.5 + title 0.2 + listed domain 0.2 + at most 0.2 for terms + province 0.1, within 0 and 1."""
    title, url, domain = F.lower(F.coalesce(col(title), F.lit(""))), F.lower(col(url)), F.lower(col(domain))
    content = F.concat_ws(" ", title, url)
    listed = F.lit(False)
    for entry in allowlist:
        listed = listed | F.contains(domain, F.lit(entry))
    local = F.lit(False)
    for name, words in PROVINCE_TERMS.items():
        local = local | ((col(province) == name) & any_of(content, words))
    score = (
        F.lit(0.5)
        + F.when(F.length(title) > 0, 0.2).otherwise(0.0)
        + F.when(listed, 0.2).otherwise(0.0)
        + F.least(term_hits(content, DISCOVERY_TERMS) * 0.05, F.lit(0.2))
        + F.when(local, 0.1).otherwise(0.0)
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def online_score(text, question, doc_class, province, asset) -> Column:
    """2 per occurrence of the question and its scope terms, 0.5 per cue word."""
    lowered = F.lower(col(text))
    return asked_score(lowered, cue_count(lowered), question, doc_class, province, asset)


def cue_count(lowered: Column | str) -> Column:
    return F.regexp_count(col(lowered), F.lit("|".join(CUE_WORDS)))


def asked_score(lowered, cues, question, doc_class, province, asset) -> Column:
    """``online_score`` of a text in lower case whose cue words are counted."""
    keys = [F.lower(F.coalesce(col(k), F.lit(""))) for k in (question, doc_class, province, asset)]
    main = sum((count_literal(col(lowered), k) for k in keys), F.lit(0))
    return main * 2.0 + col(cues) * 0.5


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def overall_confidence(*scores: Column | str) -> Column:
    """Mean of the first five; the sixth takes part only when positive."""
    five = sum((col(s) for s in scores[:5]), F.lit(0.0))
    sixth = col(scores[5])
    return F.when(sixth > 0, (five + sixth) / 6).otherwise(five / 5)


def ontology_path(*levels: Column | str) -> Column:
    return F.concat_ws(" → ", *[col(level) for level in levels])
