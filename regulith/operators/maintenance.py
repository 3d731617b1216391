"""Table maintenance: upsert, status changes, supersession, deletion, retention, caching.

Parquet has no MERGE: each operator returns the new version of the table, to be written as a new
snapshot. ``as_of`` is always passed in.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulith.operators.joins import sync_diff
from regulith.operators.windows import latest_per_key


def _merged(target: DataFrame, updates: DataFrame, keys: list[str], cols: list[str], keep_old_on_null: bool) -> DataFrame:
    fresh = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_u"))
    joined = target.withColumn("_t", F.lit(True)).join(fresh, keys, "full_outer")
    values = {}
    for c in cols:
        new = F.coalesce(F.col(f"_new_{c}"), F.col(c)) if keep_old_on_null else F.col(f"_new_{c}")
        values[c] = F.when(F.col("_u"), new).otherwise(F.col(c))
    op = F.when(F.col("_t").isNull(), "inserted").when(F.col("_u"), "updated").otherwise("kept")
    return joined.withColumns({**values, "change": op}).drop("_t", "_u", *[f"_new_{c}" for c in cols])


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], cols: list[str], as_of: dt.datetime,
           order: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Insert or update by key; of equal keys in the batch the row last by ``order`` wins. Returns (table, counts).

    Counts come from the same joined rows, per change.
    """
    by = [order] if isinstance(order, str) else list(order)
    if not by:
        raise ValueError("name the columns that order the rows of a key")
    batch = latest_per_key(updates, keys, [F.col(c).desc() for c in by])
    merged = _merged(target, batch, keys, cols, keep_old_on_null=False)
    merged = merged.withColumn("updated_at", F.when(F.col("change") != "kept", F.lit(as_of)).otherwise(
        F.col("updated_at") if "updated_at" in target.columns else F.lit(None).cast("timestamp")))
    counts = merged.groupBy("change").agg(F.count("*").alias("count"))
    return merged, counts


def upsert_metrics(metrics: DataFrame, updates: DataFrame, keys=("province", "doc_class", "evaluation_date")) -> DataFrame:
    """Create or update; a NULL in the update leaves the stored value."""
    cols = [c for c in updates.columns if c not in keys]
    return _merged(metrics, updates, list(keys), cols, keep_old_on_null=True)


def apply_status(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Latest status event per job; processing sets started_at, completed or failed sets completed_at."""
    last = latest_per_key(events, ["job_id"], [F.col("occurred_at").desc(), F.col("event_id").desc()]).select(
        "job_id", F.col("status").alias("_status"), F.col("occurred_at").alias("_at"))
    joined = jobs.join(last, "job_id", "left")
    done = F.col("_status").isin("completed", "failed")
    return joined.withColumns({
        "job_status": F.coalesce("_status", "job_status"),
        "started_at": F.when(F.col("_status") == "processing", F.col("_at")),
        "completed_at": F.when(done, F.col("_at")).otherwise(F.col("completed_at")),
    }).drop("_status", "_at")


def mark_superseded(citations: DataFrame, mapping: DataFrame) -> DataFrame:
    joined = citations.join(mapping, citations["citation_id"] == mapping["old_id"], "left")
    return joined.withColumn("superseded_by", F.coalesce("new_id", "superseded_by")).drop("old_id", "new_id")


def delete_where(df: DataFrame, citation_ids: DataFrame | None = None, chunk_ids: DataFrame | None = None,
                 province: str | None = None) -> DataFrame:
    """Delete rows meeting all given criteria; without any criterion nothing may be deleted."""
    if citation_ids is None and chunk_ids is None and province is None:
        raise ValueError("name at least one criterion")
    doomed = F.lit(True) if province is None else F.coalesce(F.col("province") == province, F.lit(False))
    rows = df
    for name, keys in (("citation_id", citation_ids), ("chunk_id", chunk_ids)):
        if keys is not None:
            listed = keys.select(name).distinct().withColumn(f"_{name}_listed", F.lit(True))
            rows = rows.join(listed, name, "left")  # a row without the id matches no list
            doomed = doomed & F.coalesce(F.col(f"_{name}_listed"), F.lit(False))
    return rows.filter(~doomed).select(*df.columns)


def retry_failed(jobs: DataFrame, as_of: dt.datetime, hours: float = 24) -> DataFrame:
    since = F.lit(as_of - dt.timedelta(hours=hours))
    picked = (F.col("job_status") == "failed") & (F.col("retry_count") < F.col("max_retries")) & (F.col("completed_at") >= since)
    return jobs.filter(picked).withColumns({"job_status": F.lit("retrying"), "retry_count": F.col("retry_count") + 1})


def registry_sync_plan(registry: DataFrame, sources: DataFrame, cols: list[str]) -> DataFrame:
    return sync_diff(registry, sources, "domain", cols).select("domain", "action")


def retention(snapshots: DataFrame, as_of: dt.datetime, days_old: int, retention_days: int) -> DataFrame:
    """Expiry date and purge flag: old enough, and past the guaranteed retention."""
    expires = F.date_add(F.to_date("fetched_at"), retention_days)
    old = F.col("fetched_at") < F.lit(as_of - dt.timedelta(days=days_old))
    return snapshots.withColumn("expires_on", expires).withColumn("purge", old & (expires <= F.lit(as_of.date())))


def pack_expiry(packs: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    out = packs.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(F.lit(days)))
    out = out.withColumn("is_expired", F.col("expires_at") < F.lit(as_of))
    return out.withColumn("new_status", F.when(F.col("is_expired"), "expired").otherwise(F.col("pack_status")))


def cached_packs(questions: DataFrame, packs: DataFrame, as_of: dt.datetime, hours: float = 24) -> DataFrame:
    """Newest generated pack per fingerprint inside the time limit, looked up for each question."""
    usable = packs.filter((F.col("pack_status") == "generated") & (F.col("created_at") >= F.lit(as_of - dt.timedelta(hours=hours))))
    newest = latest_per_key(usable, ["query_fingerprint"], [F.col("created_at").desc(), F.col("pack_id").desc()])
    held = [c for c in ("pack_id", "created_at", "answer_zh", "citation_ids") if c in packs.columns]
    return questions.join(newest.select("query_fingerprint", *held), "query_fingerprint", "left")


def append_new_snapshots(new: DataFrame, existing: DataFrame, key: str = "storage_key") -> tuple[DataFrame, DataFrame]:
    """Write-once: (rows to store, rows whose key exists already)."""
    known = existing.select(key)
    return new.join(known, key, "left_anti"), new.join(known, key, "left_semi")
