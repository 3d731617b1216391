"""Usage quotas, live statistics, sessions. Each stream has a batch twin with the same result.

Late data: rows older than the watermark (10 minutes unless stated) are dropped by the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regulith.operators.scans import group_key, range_segments, running_sums

WATERMARK = "10 minutes"


def requests_per_minute(events: DataFrame, limit: int = 60, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Requests per client and calendar minute with an over-quota flag; stream or batch."""
    rows = events.withWatermark(ts, WATERMARK) if events.isStreaming else events
    counted = rows.groupBy(key, F.window(ts, "1 minute").alias("w")).agg(F.count("*").alias("requests"))
    return counted.select(key, F.col("w.start").alias("minute"), "requests", (F.col("requests") > limit).alias("over_quota"))


def sliding_usage(events: DataFrame, key: str, window: str, slide: str, limit: int, ts: str = "ts") -> DataFrame:
    """Requests per key in overlapping windows; stream or batch."""
    rows = events.withWatermark(ts, WATERMARK) if events.isStreaming else events
    counted = rows.groupBy(key, F.window(ts, window, slide).alias("w")).agg(F.count("*").alias("requests"))
    return counted.select(key, F.col("w.start").alias("start"), "requests", (F.col("requests") > limit).alias("over_quota"))


def trailing_usage(events: DataFrame, key: str, tie: str, seconds: int, limit: int, ts: str = "ts") -> DataFrame:
    """Requests of the key in the ``seconds`` up to each request, exactly.

    Each request puts three marks on its key's time line: itself, one after all requests of its time, and one before all
    that are ``seconds`` older. The difference of the requests counted up to the latter two is its use. Counts run over
    slices of equal numbers of marks, so a key, or a moment, may hold most of them.
    """
    us, reach = F.unix_micros(ts), seconds * 1_000_000
    mark = lambda at, kind, sign: F.struct(at.alias("_at"), F.lit(kind).alias("_kind"), F.lit(sign).alias("_sign"))
    marks = F.explode(F.array(mark(us - reach, 0, -1), mark(us, 1, 0), mark(us, 2, 1)))
    rows = events.withColumn("_g", group_key([key])).select(key, tie, ts, "_g", marks.alias("_m")).select(key, tie, ts, "_g", "_m.*")
    order = [F.col("_at"), F.col("_kind"), F.col(tie)]
    cut = range_segments(rows, F.col("_g"), *order, label="marks")
    counted = running_sums(cut, ["_g"], order, {"_n": (F.col("_kind") == 1).cast("bigint")})
    used = counted.filter("_sign <> 0").groupBy(key, tie, ts).agg(F.sum(F.col("_sign") * F.col("_n")).alias("used"))
    return used.select(key, tie, ts, "used", (F.col("used") > limit).alias("over_quota"))


def live_stats(events: DataFrame, by: str, value: str, success) -> DataFrame:
    """Totals and the mean over successes per service; update mode on a stream."""
    return events.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(success).alias("successes"), F.sum(F.when(success, F.col(value))).alias("_sum")
    ).withColumn("avg_value", F.try_divide("_sum", "successes")).drop("_sum")


def job_state(events: DataFrame, max_retries: int = 3) -> DataFrame:
    """Current state per job folded from its events: latest status, failures, retry decision.

    Latest-by-time and a count do not depend on arrival order, so the fold is an aggregate with a
    partial step; a hot job needs no ordered pass over its events.
    """
    folded = events.groupBy("job_id").agg(F.max(F.struct("occurred_at", "event_id", "status")).alias("m"), F.count_if(F.col("status") == "failed").alias("failures"))
    status = F.when((F.col("m.status") == "failed") & (F.col("failures") <= max_retries), "pending").otherwise(F.col("m.status"))
    return folded.select("job_id", status.alias("status"), "failures", F.col("m.occurred_at").alias("updated_at"))


def trace_sessions(logs: DataFrame, key: str = "trace_id", ts: str = "created_at", gap_seconds: int = 1800) -> DataFrame:
    """Sessions per trace: a pause of at least the gap starts a new one.

    Rows of one key inside a slice as long as the gap always share a session, so they are folded to
    one row first; sessions are then cut on the few slice rows of each key.
    """
    us, gap = F.unix_micros(ts), gap_seconds * 1_000_000
    slices = logs.groupBy(key, F.floor(us / gap).alias("_s")).agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"), F.count("*").alias("_n"))
    w = W.partitionBy(key).orderBy("_s")
    starts = F.when(F.col("_lo") - F.lag("_hi").over(w) < gap, 0).otherwise(1)
    numbered = slices.withColumn("_new", starts).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(
        F.timestamp_micros(F.min("_lo")).alias("started_at"), F.timestamp_micros(F.max("_hi")).alias("ended_at"), F.sum("_n").alias("entries"))


def session_stream(stream: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """The streaming form: native session windows behind a watermark."""
    grouped = stream.withWatermark(ts, WATERMARK).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("entries"))
    return grouped.select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("closes_at"), "entries")
