"""Topics, guardrails and per-citation policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulith.functions.urls import url_host
from regulith.operators.filters import allow_domains
from regulith.operators.joins import map_value
from regulith.operators.windows import first_match
from regulith.sources import vocab


def topic_group(citations: DataFrame, rules: dict[str, list[str]], rest: str, text_cols: list[str], out: str = "topic") -> DataFrame:
    """The first topic whose keywords occur claims the citation."""
    text = F.concat_ws(" ", *[F.lower(F.col(c)) for c in text_cols])
    return citations.withColumn(out, first_match(text, rules, rest))


# Violation reasons in checking order.
REASONS = ["no_first_party_citation", "stale_citation", "missing_effective_date", "province_mismatch", "doc_class_mismatch",
           "placeholder_url_detected", "domain_not_allowed", "superseded_citation"]


def _host_flags(results: DataFrame, allow: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Adds ``_listed`` and ``_placeholder``, decided once per distinct host."""
    rows = results.withColumn("domain", url_host("url"))
    hosts = rows.select("domain").distinct()
    listed = allow_domains(hosts, allow).withColumn("_listed", F.lit(True))
    dummy = placeholders.select("domain").distinct().withColumn("_placeholder", F.lit(True))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        rows.join(listed, "domain", "left").join(dummy, "domain", "left")
        .withColumn("_listed", yes("_listed")).withColumn("_placeholder", yes("_placeholder"))
    )


def _violation() -> Column:
    """Position of the first violated rule of one citation in ``REASONS``, NULL if it passes."""
    empty = lambda c: F.coalesce(F.length(F.col(c).cast("string")) == 0, F.lit(True))
    rules = [
        (1, empty("checksum")), (2, empty("effective_date")),
        (3, ~F.col("province").isin(vocab.PROVINCES)), (4, ~F.col("doc_class").isin(vocab.DOC_CLASSES)),
        (5, F.col("_placeholder")), (6, (F.length("domain") > 0) & ~F.col("_listed")), (7, F.col("superseded_by").isNotNull()),
    ]
    out = F
    for position, bad in rules:
        out = out.when(F.coalesce(bad, F.lit(False)), F.lit(position))
    return out.otherwise(F.lit(None).cast("int"))


def guardrails(results: DataFrame, queries: DataFrame, allow: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Per question: the first violated policy, or a pass.

    Order of a sequential check: metadata citation by citation, then the scope of the question, then
    each host and supersession rule over all citations. The question's own scope decides rules 3 and 4.
    """
    rows = results.drop("province", "doc_class").join(queries.select("question_id", "province", "doc_class"), "question_id")
    flagged = _host_flags(rows, allow, placeholders).withColumn("_v", _violation())
    meta = F.min(F.when(F.col("_v") <= 2, F.struct("rank", "_v")))["_v"]
    worst = flagged.groupBy("question_id").agg(F.count("*").alias("citations"), F.coalesce(meta, F.min("_v")).alias("_v"))
    names = F.array(*[F.lit(r) for r in REASONS])
    joined = queries.select("question_id").join(worst, "question_id", "left")
    position = F.when(F.coalesce("citations", F.lit(0)) == 0, F.lit(0)).otherwise(F.col("_v"))
    return joined.select(
        "question_id", F.coalesce("citations", F.lit(0)).alias("citations"),
        F.get(names, position).alias("refusal_reason"), F.when(position.isNull(), "pass").otherwise("refused").alias("verdict"))


def filter_by_policy(results: DataFrame, queries: DataFrame, allow: DataFrame, placeholders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop only failing citations. Returns (kept citations, verdict per question)."""
    flagged = _host_flags(results, allow, placeholders).withColumn("_v", _violation())
    kept = flagged.filter("_v is null").drop("_v", "_listed", "_placeholder", "domain")
    counts = flagged.groupBy("question_id").agg(F.count("*").alias("found"), F.count_if(F.col("_v").isNull()).alias("kept"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    verdicts = queries.select("question_id").join(counts, "question_id", "left").select(
        "question_id", zero("found").alias("found"), zero("kept").alias("kept"),
        F.when(zero("found") == 0, "no_citations").when(zero("kept") == 0, "policy_violation").otherwise("ok").alias("verdict"))
    return kept, verdicts


def with_refusal_template(refusals: DataFrame) -> DataFrame:
    """Bilingual message and suggestion, with province and asset filled in where the code asks for it."""
    by_code = lambda i: map_value("code", {r[0]: r[i] for r in vocab.REFUSALS})
    province = map_value("province", vocab.PROVINCE_LONG_LABELS)
    asset = map_value("asset", vocab.ASSET_LABELS, F.col("asset"))
    personal = (F.col("code") == "asset_not_supported") & province.isNotNull() & F.col("asset").isNotNull()
    hint = (F.col("code") == "no_first_party_citation") & province.isNotNull()
    return refusals.withColumns({
        "message_zh": F.when(personal, F.concat(F.lit("抱歉，"), province, F.lit("暂无"), asset, F.lit("相关的政策资料。"))).otherwise(by_code(1)),
        "message_en": by_code(2),
        "suggestion_zh": F.when(hint, F.concat(by_code(3), F.lit(" 您也可以直接访问"), province, F.lit("电力交易中心官网获取最新信息。"))).otherwise(by_code(3)),
        "suggestion_en": by_code(4),
    })


def with_eligibility(refusals: DataFrame, code: str = "code") -> DataFrame:
    """May the refusal become an ingestion request; unknown codes may, with low priority."""
    known = F.col(code).isin([r[0] for r in vocab.ELIGIBILITY])
    barred = F.col(code).isin([r[0] for r in vocab.ELIGIBILITY if not r[1]])
    priority = F.when(known, map_value(code, {r[0]: r[3] for r in vocab.ELIGIBILITY if r[3]})).otherwise("low")
    days = F
    for name, n in vocab.PROCESSING_DAYS.items():
        days = days.when(priority == name, F.lit(n))
    text = F.when(days <= 1, "1 business day").when(days <= 2, "1-2 business days").when(days <= 3, "2-3 business days").when(days <= 5, "3-5 business days")
    return refusals.withColumns({
        "eligible": ~barred, "reason": map_value(code, {r[0]: r[2] for r in vocab.ELIGIBILITY}, F.lit(vocab.UNKNOWN_REASON)),
        "suggested_priority": priority, "alternative": map_value(code, {r[0]: r[4] for r in vocab.ELIGIBILITY if r[4]}),
        "processing_days": days, "processing_time": text,
    })
