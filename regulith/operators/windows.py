"""Latest rows, top-k, running values, ordered pages and set operations.

Top-k by ``row_number() <= k`` is planned with a window group limit before the shuffle, so a hot key
sends k rows per input partition instead of all of its rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regulith.functions.scoring import any_of
from regulith.operators.joins import rank_of
from regulith.operators.scans import SEGMENT, group_key, page, range_segments, running_sums
from regulith.session import col
from regulith.sources import vocab


def topk_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return topk_per_key(df, keys, order, 1, "_rn").drop("_rn")


def dedup_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order."""
    return latest_per_key(df, keys, order)


def last_n(df: DataFrame, ts: str, tie: str, n: int = 1000) -> DataFrame:
    """The newest n rows overall: each partition keeps n, the driver merges n."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def running_average(df: DataFrame, keys: list[str], ts: str, tie: str, value: str) -> DataFrame:
    """Average of all rows of the key up to each row, by sums over slices of equal row counts: a key may hold most rows."""
    named = df.withColumn("_g", group_key(keys)).withColumn("_x", F.col(value).cast("double"))
    cut = range_segments(named, F.col("_g"), F.col(ts), F.col(tie), label="running-average")
    none = F.coalesce("_x", F.lit(0.0))
    counted = F.col("_x").isNotNull().cast("bigint")
    summed = running_sums(cut, ["_g"], [F.col(ts), F.col(tie)], {"_s": none, "_n": counted})
    average = F.try_divide(F.col("_s") + none, F.col("_n") + counted)
    return summed.withColumn("running_avg", average).select(*df.columns, "running_avg")


def cumulative_offsets(chunks: DataFrame, doc_id: str = "doc_id", order: str = "pos", content: str = "content") -> DataFrame:
    """Start and end of each chunk in the concatenation of its document's chunks, by sums over slices of equal row counts."""
    named = chunks.withColumn("_g", group_key([doc_id])).withColumn("_len", F.coalesce(F.length(content), F.lit(0)))
    cut = range_segments(named, F.col("_g"), F.col(order), label="offsets")
    placed = running_sums(cut, ["_g"], [F.col(order)], {"start_char": F.col("_len")})
    return placed.withColumn("end_char", F.col("start_char") + F.col("_len")).drop("_len", "_g", SEGMENT)


def with_ordinal(df: DataFrame, array_col: str, keep: list[str]) -> DataFrame:
    """One row per element with its 1-based position."""
    return df.select(*keep, F.posexplode(array_col).alias("_p", "item")).withColumn("ordinal", F.col("_p") + 1).drop("_p")


def share_of_total(df: DataFrame, count_col: str) -> DataFrame:
    """Share by a scalar subquery: no window over an unpartitioned table."""
    total = df.agg(F.sum(count_col)).scalar()
    return df.withColumn("share", F.try_divide(F.col(count_col).cast("double"), total))


def first_match(c: Column | str, rules: dict[str, list[str]], default: str) -> Column:
    """Name of the first rule whose words occur in the text."""
    out = F
    for name, words in rules.items():
        out = out.when(any_of(col(c), words), F.lit(name))
    return out.otherwise(F.lit(default))


def superseded_map(citations: DataFrame, identity: list[str], ties: list[str] = ()) -> DataFrame:
    """(old, new) pairs: the newest effective citation replaces the others of the same identity.

    Citations of one date are told apart by ``ties``, then by their id; the largest is the newest.
    """
    newest = citations.groupBy(*identity).agg(
        F.max(F.struct("effective_date", *ties, "citation_id")).alias("_m")
    ).select(*identity, F.col("_m.citation_id").alias("new_id"))
    joined = citations.select(*identity, F.col("citation_id").alias("old_id")).join(newest, identity)
    return joined.filter("old_id <> new_id").select("old_id", "new_id")


def latest_citations(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.col("effective_date").desc(), F.col("citation_id")).limit(limit)


def page_signals(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    order = [F.col("relevance_score").desc(), F.col("published_date").desc(), F.col("signal_id")]
    return page(df, order, limit, offset).drop("position")


def top_scored(df: DataFrame, k: int = 3) -> DataFrame:
    return topk_per_key(df, ["question_id"], [F.col("score").desc(), F.col("url")], k)


def deadlines_before(signals: DataFrame, as_of: dt.date, days: int = 30, lower: dt.date | None = None) -> DataFrame:
    out = signals.filter(F.col("deadline_date") <= F.lit(as_of + dt.timedelta(days=days)))
    return out.filter(F.col("deadline_date") >= F.lit(lower)) if lower else out


def upcoming_deadlines(signals: DataFrame, as_of: dt.date, k: int = 5, days: int = 30, lower: dt.date | None = None) -> DataFrame:
    return deadlines_before(signals, as_of, days, lower).orderBy("deadline_date", "signal_id").limit(k)


def top_codes(refusals: DataFrame, k: int = 5) -> DataFrame:
    counts = refusals.groupBy("code").agg(F.count("*").alias("count"))
    return share_of_total(counts, "count").orderBy(F.col("count").desc(), "code").limit(k)


def order_by_rank(df: DataFrame, name: str = "priority", tie: str = "domain") -> DataFrame:
    return df.withColumn("priority_rank", rank_of(name, vocab.PRIORITY_ORDER, 3)).orderBy("priority_rank", tie)


def pending_jobs(jobs: DataFrame, job_type: str | None = None, limit: int = 100) -> DataFrame:
    out = jobs.filter(F.col("job_status") == "pending")
    out = out.filter(F.col("job_type") == job_type) if job_type else out
    return out.orderBy("scheduled_at", "job_id").limit(limit)


def best_candidates(df: DataFrame, max_results: int) -> DataFrame:
    return df.orderBy(F.col("confidence_score").desc(), "candidate_id").limit(max_results)


def list_requests(df: DataFrame, status: str | None = None, priority: str | None = None, limit: int = 50) -> DataFrame:
    for name, value in (("status", status), ("priority", priority)):
        df = df.filter(F.col(name) == value) if value else df
    return df.orderBy(F.col("submitted_at").desc(), "request_id").limit(limit)


def best_match(pairs: DataFrame, key: str, score: str, tie: str, floor: float = 0.3) -> DataFrame:
    """Highest scored partner per key, if it reaches the floor."""
    return latest_per_key(pairs.filter(F.col(score) >= floor), [key], [F.col(score).desc(), F.col(tie)])


def top_dates(hits: Column | str, k: int | None = None) -> Column:
    """Dates by confidence, ties in pattern and text order; the first k if asked for."""
    keyed = F.transform(col(hits), lambda h: F.struct(
        (-h["confidence"]).alias("s"), h["rank"].alias("rank"), h["at"].alias("at"), h["d"].alias("d"), h["context"].alias("context"), h["confidence"].alias("confidence")))
    ordered = F.array_sort(keyed)
    return ordered if k is None else F.slice(ordered, 1, k)


def domain_allowlist(registry: DataFrame, base: DataFrame) -> DataFrame:
    return registry.select("domain").unionByName(base.select("domain")).distinct()


def union_preferred(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Preferred rows first, one row per key, the first one wins."""
    both = first.withColumn("source_rank", F.lit(0)).unionByName(second.withColumn("source_rank", F.lit(1)))
    return dedup_first(both, [key], [F.col("source_rank"), F.col(order)])


def difference(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def all_sources(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out
