"""Quality gates from logs, answers and gold expectations; signal reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulith.operators.aggregates import latency_percentiles, rate, readiness
from regulith.operators.filters import SignalFilter, filter_signals
from regulith.operators.joins import match_gold
from regulith.operators.windows import page_signals

KEYS = ["province", "doc_class"]


def quality_metrics(logs: DataFrame, answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Per province and document class: groundedness, citation precision, refusal accuracy, latency, totals.

    ``answers``: question_id, scope, verdict, answer_zh, citation_id (one row per cited citation or NULL).
    ``gold``: question_id, clause, expected_citation, should_refuse.
    """
    texts = answers.select("question_id", *KEYS, "verdict", "answer_zh").dropDuplicates(["question_id"])
    checked = match_gold(texts, gold)
    expected = gold.select("question_id", F.col("expected_citation").alias("citation_id")).distinct().withColumn("_expected", F.lit(True))
    judged = answers.filter("citation_id is not null").join(gold.select("question_id").distinct(), "question_id", "left_semi")
    cited = judged.join(expected, ["question_id", "citation_id"], "left").groupBy(*KEYS).agg(rate(F.count("_expected"), F.count("*")).alias("citation_precision"))
    grounded = checked.filter("province is not null").groupBy(*KEYS).agg(
        rate(F.count_if(F.col("hit")), F.count("*")).alias("groundedness_score"),
        F.try_divide(F.count_if(F.col("should_refuse") & (F.col("verdict") == "refused")).cast("double"), F.count_if("should_refuse")).alias("refusal_accuracy"))
    totals = logs.groupBy(*KEYS).agg(
        F.count("*").alias("total_queries"), F.count_if(F.col("verdict") == "ok").alias("passed_queries"), F.count_if(F.col("verdict") == "refused").alias("refused_queries"), F.avg("latency_ms").alias("avg_latency_ms"))
    p95 = latency_percentiles(logs, "latency_ms", KEYS, (0.95,)).select(*KEYS, F.col("p95").alias("p95_latency_ms"))
    return totals.join(p95, KEYS, "left").join(grounded, KEYS, "left").join(cited, KEYS, "left")


def quality_gates(logs: DataFrame, answers: DataFrame, gold: DataFrame, evaluation_date: str, **thresholds: float) -> DataFrame:
    metrics = quality_metrics(logs, answers, gold).withColumn("evaluation_date", F.to_date(F.lit(evaluation_date)))
    return readiness(metrics, **thresholds)


def signals_report(signals: DataFrame, filters: SignalFilter, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the filtered signals with the total number of matches on every row."""
    rows = filter_signals(signals, filters)
    total = rows.agg(F.count("*").alias("n")).scalar()
    return page_signals(rows, limit, offset).withColumn("total_count", total)
