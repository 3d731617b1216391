"""Quote-first answers composed from search results, and the end-to-end batch."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulith.functions.text import fingerprint, key_clause
from regulith.operators.filters import complete_citations, enrich_results, fill_metadata
from regulith.operators.joins import map_value
from regulith.operators.maintenance import cached_packs
from regulith.operators.windows import first_match
from regulith.plans.policy import filter_by_policy
from regulith.plans.retrieval import hybrid_passages
from regulith.session import materialise
from regulith.sources import vocab

NO_RESULTS, NO_CITATIONS = "没有找到相关的一手资料", "没有找到有效的引用资料"


def refusal_text(reason: Column) -> Column:
    return F.concat(F.lit("抱歉，"), reason, F.lit("。请尝试更具体的问题或联系相关部门获取最新信息。"))


def answer_title(province: str = "province", asset: str = "asset", doc_class: str = "doc_class") -> Column:
    label = lambda c, m: map_value(c, m, F.coalesce(F.col(c), F.lit("")))
    place = label(province, vocab.PROVINCE_LABELS)
    asset_label = label(asset, vocab.ASSET_LABELS)
    scope = F.when(F.length(asset_label) > 0, F.concat(place, F.lit(" / "), asset_label)).otherwise(place)
    return F.concat(F.lit("**"), label(doc_class, vocab.DOC_CLASS_LABELS), F.lit("要点（"), scope, F.lit("）**"))


def compose_answers(results: DataFrame, queries: DataFrame, max_citations: int = 10) -> DataFrame:
    """One row per question: answer text, citations, counts.

    Results are cut to ``max_citations`` before they are grouped, so a group never exceeds that size.
    """
    topics = {**{name: i for i, name in enumerate(vocab.ANSWER_TOPICS)}, vocab.ANSWER_REST: len(vocab.ANSWER_TOPICS)}
    found = results.groupBy("question_id").agg(F.count("*").alias("_found"))
    used = complete_citations(results.filter(F.col("rank") <= max_citations))
    rows = used.withColumn("_topic", first_match(F.lower("passage"), vocab.ANSWER_TOPICS, vocab.ANSWER_REST))
    bullet = F.concat(F.lit("• "), key_clause("passage"), F.lit(" 〔《"), F.col("metadata.title"), F.lit("》，生效："), F.col("metadata.effective_date"), F.lit("〕"))
    order = F
    for name, i in topics.items():
        order = order.when(F.col("_topic") == name, F.lit(i))
    item = F.struct(order.alias("o"), "rank", F.col("_topic").alias("topic"), bullet.alias("bullet"), "citation_id",
                    F.col("metadata.title").alias("title"), F.col("metadata.url").alias("url"), F.col("metadata.effective_date").alias("effective_date"), "score")
    grouped = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("_i"))
    joined = queries.join(grouped, "question_id", "left").join(found, "question_id", "left")
    first_of_topic = lambda x, i: (i == 0) | (F.get("_i", i - 1)["o"] != x["o"])
    lines = F.transform("_i", lambda x, i: F.concat(
        F.when(first_of_topic(x, i), F.concat(F.lit("- "), x["topic"], F.lit("：\n"))).otherwise(F.lit("")), F.lit("  "), x["bullet"]))
    heads = F.filter("_i", first_of_topic)
    summary = F.array_join(F.transform(heads, lambda h: F.concat(
        F.lit("**"), h["topic"], F.lit("**: "), F.size(F.filter("_i", lambda x: x["o"] == h["o"])).cast("string"), F.lit(" requirements found"))), ", ")
    english = F.concat(F.lit("\n\n**English Summary:**\nThis response covers "), summary, F.lit(". Total citations: "), F.size("_i").cast("string"), F.lit("."))
    body = F.concat(answer_title(), F.lit("\n"), F.array_join(lines, "\n"), F.when(F.col("lang") == "en", english).otherwise(F.lit("")))
    reason = F.when(F.col("_found").isNull(), NO_RESULTS).when(F.col("_i").isNull(), NO_CITATIONS)
    by_rank = F.array_sort(F.transform("_i", lambda x: F.struct(x["rank"].alias("rank"), x["citation_id"].alias("citation_id"), x["title"].alias("title"),
                                                               x["url"].alias("url"), x["effective_date"].alias("effective_date"), x["score"].alias("score"))))
    return joined.select(
        "question_id", "province", "doc_class", "asset", F.coalesce(body, refusal_text(reason)).alias("answer_zh"), reason.alias("refusal_reason"),
        F.coalesce(F.size(heads), F.lit(0)).alias("sections"), F.coalesce(F.size("_i"), F.lit(0)).alias("total_citations"), by_rank.alias("citations"))


@dataclass(frozen=True)
class AnswerTables:
    answers: DataFrame
    packs: DataFrame
    logs: DataFrame


def answer_batch(questions: DataFrame, citations: DataFrame, packs: DataFrame, allow: DataFrame, placeholders: DataFrame,
                 as_of: dt.datetime, max_citations: int = 10, cache_hours: int = 24) -> AnswerTables:
    """Fingerprint, cache, retrieval, policy, composition; new packs and log rows for the batch."""
    keyed = questions.withColumn("query_fingerprint", fingerprint("province", "asset", "doc_class", "question", "short"))
    cached = cached_packs(keyed.select("question_id", "query_fingerprint"), packs, as_of, cache_hours).filter("pack_id is not null")
    open_questions = keyed.join(cached.select("question_id"), "question_id", "left_anti")
    wide = hybrid_passages(open_questions, citations)
    kept, _ = filter_by_policy(wide, open_questions, allow, placeholders)
    answers = compose_answers(fill_metadata(enrich_results(kept)), open_questions, max_citations)
    # Three outputs share the answers: they are written once.
    answers = materialise(answers, "answers")
    with_key = answers.join(keyed.select("question_id", "query_fingerprint"), "question_id")
    ids = F.transform("citations", lambda c: c["citation_id"])
    new_packs = with_key.filter("refusal_reason is null").select(
        F.concat(F.lit("pack-"), "query_fingerprint", F.lit(f"-{int(as_of.timestamp())}")).alias("pack_id"), F.lit(as_of).alias("created_at"), "province", "asset",
        "doc_class", "query_fingerprint", ids.alias("citation_ids"), "answer_zh", F.lit("generated").alias("pack_status"))
    fresh = with_key.select("question_id", F.when(F.col("refusal_reason").isNull(), "ok").otherwise("refused").alias("verdict"), "refusal_reason", ids.alias("citation_ids"), F.lit(False).alias("from_cache"))
    none = lambda name, kind: F.col(name) if name in packs.columns else F.lit(None).cast(kind)
    stored_ids, stored_answer = F.coalesce(none("citation_ids", "array<string>"), F.array().cast("array<string>")), none("answer_zh", "string")
    reused = cached.select("question_id", F.lit("ok").alias("verdict"), F.lit(None).cast("string").alias("refusal_reason"), stored_ids.alias("citation_ids"), F.lit(True).alias("from_cache"))
    # A cached question is answered with what its pack holds.
    blank = F.lit(None).cast("string")
    detail = answers.schema["citations"].dataType.elementType
    listed = F.transform(stored_ids, lambda i: F.struct(*[(i if f.name == "citation_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in detail.fields]))
    again = cached.join(keyed.select("question_id", "province", "doc_class", "asset"), "question_id").select(
        "question_id", "province", "doc_class", "asset", stored_answer.alias("answer_zh"), blank.alias("refusal_reason"), F.lit(0).alias("sections"),
        F.size(stored_ids).alias("total_citations"), listed.alias("citations"))
    return AnswerTables(answers.unionByName(again), new_packs, fresh.unionByName(reused).withColumn("created_at", F.lit(as_of)))
