"""Streams, run to the end of the available data, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from regulith.catalog import fold_sql as q
from regulith.catalog.base import AS_OF, query
from regulith.catalog.texts import chunk_rows
from regulith.functions.text import sha256_hex, strip
from regulith.operators import parted
from regulith.plans import chunking
from regulith.session import scratch_path
from regulith.streaming import keyed, runner, usage


def _events(v):
    stream = runner.file_stream(v.spark, v.dir, "events.parquet", v("events").schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _batch_events(v):
    return v("events").withColumn("ts", F.col("ts").cast("timestamp"))


MINUTES = "select user_id, <<t:date_trunc('minute', ts)>> \"minute\", count(*) requests, count(*) > 1 over_quota from events group by user_id, date_trunc('minute', ts)"


@query("t1_requests_per_minute", MINUTES)
def _(v):
    return usage.requests_per_minute(_batch_events(v), limit=1)


@query("t1_requests_stream", MINUTES)
def _(v):
    return runner.run_update(usage.requests_per_minute(_events(v), limit=1), ["user_id", "minute"], "requests")


SLIDING = """select user_id, <<t:s>> "start", count(*) requests, count(*) > 2 over_quota from (select user_id, unnest([time_bucket(interval '10 minutes', ts) - k * interval '10 minutes' for k in range(0, 6)]) s from events) group by user_id, s"""


@query("t2_sliding_usage", SLIDING)
def _(v):
    return usage.sliding_usage(_batch_events(v), "user_id", "60 minutes", "10 minutes", 2)


@query("t2_sliding_stream", SLIDING)
def _(v):
    return runner.run_update(usage.sliding_usage(_events(v), "user_id", "60 minutes", "10 minutes", 2), ["user_id", "start"], "sliding")


@query("t2_trailing_usage", "select event_id, count(*) over w used, count(*) over w > 30 over_quota from events window w as (partition by event_type order by ts range between interval '3600' second preceding and current row)")
def _(v):
    return usage.trailing_usage(_batch_events(v), "event_type", "event_id", 3600, 30).select("event_id", "used", "over_quota")


@query("t2_trailing_stream", """select event_type, event_id, <<t:ts>> ts, used, used > 30 over_quota from (select *, count(*) over w used from events window w as (partition by event_type order by ts range between interval '3600' second preceding and current row))
 where epoch_us(ts) < floor((select max(epoch_us(ts)) from events) / 1000.0) * 1000 - 600000000""")
def _(v):
    keyed.use_keyed_state(v.spark)
    return runner.run_append(keyed.trailing_quota_stream(_events(v), "event_type", "event_id", 3600, 30, "10 minutes"), "trailing")


@query("t3_dedup_stream", "select sha256(html) checksum, <<t:timestamp '2024-01-01 00:00:00' + cast(min(page_id) as int) * interval '1' minute>> fetched_at, 'first' run from pages group by 1")
def _(v):
    """Two streams over the same pages into one table: the second finds every checksum stored."""
    target = scratch_path(v.spark, "seen")
    for run in ("first", "second"):
        pages = runner.file_stream(v.spark, v.dir, "pages.parquet", v("pages").schema)
        fetched = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)
        rows = pages.select(sha256_hex("html").alias("checksum"), fetched.alias("fetched_at"))
        out = runner.dedup_stream(rows, target, "checksum", ["fetched_at"], run)
    return out.select("checksum", "fetched_at", "run")


JOB_STATE = """select job_id, case when arg_max(status, (occurred_at, event_id)) = 'failed' and count(*) filter (status = 'failed') <= 3 then 'pending' else arg_max(status, (occurred_at, event_id)) end status,
 count(*) filter (status = 'failed') failures, <<t:max(occurred_at)>> updated_at from job_event_v group by 1"""


@query("t5_job_state", JOB_STATE)
def _(v):
    return usage.job_state(v("job_event_v"))


@query("t5_job_state_stream", JOB_STATE)
def _(v):
    status = F.expr("case event_type when 'click' then 'processing' when 'view' then 'pending' when 'error' then 'failed' when 'signup' then 'retrying' else 'completed' end")
    rows = _events(v).select("event_id", F.col("user_id").alias("job_id"), status.alias("status"), F.col("ts").alias("occurred_at"))
    return runner.run_update(usage.job_state(rows), ["job_id"], "job-state")


LIFECYCLE = """with f as (select job_id, arg_max(status, (occurred_at, event_id)) last, count(*) filter (status = 'failed') failures, max(occurred_at) updated_at from job_event_v group by 1),
 s as (select *, case when last = 'failed' and failures <= 3 then 'pending' else last end shown from f)
 select job_id, case when shown not in ('completed', 'failed') and epoch_us(updated_at) + 432000000000 < (select max(epoch_us(occurred_at)) - 600000000 from job_event_v) then 'timed_out' else shown end status, failures, <<t:updated_at>> updated_at from s"""


@query("t5_job_lifecycle", LIFECYCLE)
def _(v):
    return keyed.job_lifecycle(v("job_event_v"), 432_000, 600)


@query("t5_job_lifecycle_stream", LIFECYCLE)
def _(v):
    keyed.use_keyed_state(v.spark)
    status = F.expr("case event_type when 'click' then 'processing' when 'view' then 'pending' when 'error' then 'failed' when 'signup' then 'retrying' else 'completed' end")
    rows = _events(v).select("event_id", F.col("user_id").alias("job_id"), status.alias("status"), F.col("ts").alias("occurred_at"))
    return runner.run_update(keyed.job_lifecycle_stream(rows, 432_000, "10 minutes"), ["job_id"], "lifecycle", within=("seq",)).drop("seq")


LIVE = "select event_type, count(*) total, count(*) filter (value > 10) successes, <<r:avg(value) filter (value > 10)>> avg_value from events group by 1"


@query("t6_live_stats", LIVE)
def _(v):
    return usage.live_stats(_batch_events(v), "event_type", "value", F.col("value") > 10)


@query("t6_live_stream", LIVE)
def _(v):
    return runner.run_update(usage.live_stats(_events(v), "event_type", "value", F.col("value") > 10), ["event_type"], "live")


DOC_CHUNKS = chunk_rows(q.paragraphs("(select doc_id, '' url, text from documents)"), 200, 40, 10)


@query("t7_ingest_stream", f"select chunk_id, doc_id, pos, token_count, clause_type, 'inserted' change from ({DOC_CHUNKS})")
def _(v):
    docs = runner.file_stream(v.spark, v.dir, "documents.parquet", v("documents").schema)
    to_chunks = lambda batch: chunking.chunk_document(chunking.with_paragraphs(batch.select("doc_id", "text")), 200, 40, 10)
    out = runner.ingest_stream(docs, to_chunks, scratch_path(v.spark, "ingest"), ["chunk_id"], ["doc_id", "pos", "content", "token_count", "clause_type"], AS_OF, order="content", owner="doc_id")
    return out.select("chunk_id", "doc_id", "pos", "token_count", "clause_type", "change")


SECTIONS = """(select doc_id, unnest(range(1, len(p) + 1)) ordinal, trim(unnest(p), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') content from (select doc_id, string_split(text, chr(10)) p from documents))"""


@query("t7_ingest_sections", f"""select doc_id, ordinal, length(content) n_chars, 'inserted' change from {SECTIONS} where content <> ''
 union all select doc_id, 0 ordinal, length(text) n_chars, 'inserted' change from documents where text is not null""")
def _(v):
    """Documents and their lines, merged by partition as they arrive."""
    docs = runner.file_stream(v.spark, v.dir, "documents.parquet", v("documents").schema)
    parts = F.concat(F.array("text"), F.split("text", "\\n", -1))

    def sections(batch):
        rows = batch.filter("text is not null").select("doc_id", F.posexplode(parts).alias("ordinal", "part"))
        return rows.select("doc_id", "ordinal", F.when(F.col("ordinal") == 0, F.col("part")).otherwise(strip("part")).alias("content")).filter("ordinal = 0 or content <> ''")

    out = runner.ingest_stream(docs, sections, scratch_path(v.spark, "sections"), ["doc_id", "ordinal"], ["content"], AS_OF, order="content", owner="doc_id")
    return out.select("doc_id", "ordinal", F.length("content").alias("n_chars"), "change")


@query("m5_delete_by_partition", f"select doc_id, ordinal, length(content) n_chars from {SECTIONS} where content <> '' and doc_id % 7 <> 3")
def _(v):
    """Lines merged into a partitioned table, then those of some documents deleted in their partitions."""
    lines = v.dealt("documents").select("doc_id", F.posexplode(F.split("text", "\\n", -1)).alias("pos", "part"))
    lines = lines.select("doc_id", (F.col("pos") + 1).alias("ordinal"), strip("part").alias("content")).filter("content <> ''")
    target = scratch_path(v.spark, "lines")
    parted.merge_into(target, lines, ["doc_id", "ordinal"], ["content"], "doc_id", AS_OF, "content")
    parted.delete_from(target, v("documents").filter("doc_id % 7 = 3"), "doc_id", v.spark)
    return v.spark.read.parquet(target).select("doc_id", "ordinal", F.length("content").alias("n_chars"))


@query("t8_trace_sessions", """select trace_id, <<i:session>> "session", <<t:min(created_at)>> started_at, <<t:max(created_at)>> ended_at, count(*) entries from (select *, sum(fresh) over (partition by trace_id order by created_at, log_id) "session"
 from (select *, case when created_at - lag(created_at) over (partition by trace_id order by created_at, log_id) < interval '1800' second then 0 else 1 end fresh from query_log_v)) group by trace_id, "session" """)
def _(v):
    return usage.trace_sessions(v("query_log_v"))


@query("t8_trace_log", "select trace_id, log_id, <<t:created_at>> created_at from query_log_v where trace_id in (select trace_id from query_log_v where verdict = 'refused') order by trace_id, created_at, log_id")
def _(v):
    from regulith.operators.joins import lookup

    logs = v("query_log_v").select("trace_id", "log_id", "created_at", "verdict")
    wanted = lookup(logs, logs.filter("verdict = 'refused'").select("trace_id").distinct(), "trace_id")
    # A global sort is split by range, so one long trace is not one task.
    return wanted.select("trace_id", "log_id", "created_at").orderBy("trace_id", "created_at", "log_id")
