"""Effective dates of documents: tiered extraction, all candidates, validation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulith.functions import dates as d
from regulith.operators.windows import top_dates


def effective_date(docs: DataFrame, as_of: dt.date, head: int | None = None) -> DataFrame:
    """Announced effect, then the URL, then issue or approval, then the first date of the text (of its first ``head`` characters, if given)."""
    # Every rule for the text needs a year; texts without one skip them all after one test.
    text = F.when(F.col("text").rlike(r"20\d{2}"), F.col("text"))
    dated = docs.withColumn("_t", text)
    text = F.col("_t")
    return dated.withColumn("effective_date", F.coalesce(
        d.context_date(text, as_of), d.date_from_url("url", as_of), d.publication_date(text, as_of), d.first_date(text, as_of, head))).drop("_t")


def effective_date_simple(docs: DataFrame, as_of: dt.date) -> DataFrame:
    return docs.withColumn("effective_date", d.effective_date_simple("text", "url", as_of))


def date_candidates(docs: DataFrame, as_of: dt.date) -> DataFrame:
    """Every date with its context and confidence, best first."""
    ranked = F.array_sort(F.transform(d.date_hits("text", as_of), lambda h: F.struct(
        (-h["confidence"]).alias("s"), h["rank"].alias("rank"), h["at"].alias("at"), h["d"].alias("d"), h["context"].alias("context"), h["confidence"].alias("confidence"))))
    return docs.select("doc_id", F.posexplode(ranked).alias("pos", "h")).select(
        "doc_id", "pos", F.col("h.d").alias("date"), "h.context", "h.confidence", F.col("h.rank").alias("pattern"))


def date_validation(docs: DataFrame, as_of: dt.date, keep: int = 5) -> DataFrame:
    """Validity, confidence of the chosen date, notes and the best alternatives."""
    found = effective_date(docs, as_of).withColumn("_hits", d.date_hits("text", as_of))
    day = F.col("effective_date")
    valid = F.coalesce(d.reasonable(day, as_of), F.lit(False))
    all_sorted = top_dates("_hits")
    same = F.try_element_at(F.filter(all_sorted, lambda h: h["d"] == day), F.lit(1))
    note = (
        F.when(day.isNull(), "No effective date found").when(~valid, "Date is outside reasonable range")
        .when(day > F.lit(as_of), "Future effective date").when(F.date_diff(F.lit(as_of), day) > 365 * 5, "Effective date is more than 5 years old")
    )
    return found.select(
        "doc_id", "effective_date", valid.alias("is_valid"), F.when(valid, F.coalesce(same["confidence"], F.lit(0.0))).otherwise(0.0).alias("confidence"),
        note.alias("note"), F.when(valid, F.transform(top_dates("_hits", keep), lambda h: F.date_format(h["d"], "yyyy-MM-dd"))).otherwise(F.array().cast("array<string>")).alias("alternatives"))
