"""Table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from regulith.catalog.base import AS_OF, ORDERS_AS_OF, query
from regulith.catalog.joins import SYNC_COLS, SYNC_SQL, sync_sides
from regulith.functions.text import sha256_hex
from regulith.operators import maintenance as m
from regulith.operators import windows as w

# Two versions of the customer table: nine tenths remain, some change, some are new.
OLD = "(select citation_id, title, province from citation_base where asset is not null)"
NEW = "(select citation_id, concat(title, ' v2') title, 'shandong' province, doc_id seq from citation_base where doc_class = 'dispatch_ops' union all select citation_id, 'stale', 'x', -1 from citation_base where doc_class = 'dispatch_ops')"
UPSERT = f"""(select coalesce(o.citation_id, n.citation_id) citation_id, case when n.citation_id is null then o.title else n.title end title,
 case when n.citation_id is null then o.province else n.province end province, case when o.citation_id is null then 'inserted' when n.citation_id is null then 'kept' else 'updated' end change
 from {OLD} o full outer join (select * from {NEW} qualify row_number() over (partition by citation_id order by seq desc) = 1) n on o.citation_id = n.citation_id)"""


def _upsert(v):
    base = v("citation_base").select("citation_id", "title", "province", "asset", "doc_class", "doc_id")
    old = base.filter("asset is not null").select("citation_id", "title", "province")
    part = base.filter("doc_class = 'dispatch_ops'")
    new = part.select("citation_id", F.concat("title", F.lit(" v2")).alias("title"), F.lit("shandong").alias("province"), F.col("doc_id").alias("seq"))
    outdated = part.select("citation_id", F.lit("stale").alias("title"), F.lit("x").alias("province"), F.lit(-1).alias("seq"))
    return m.upsert(old, new.unionByName(outdated), ["citation_id"], ["title", "province"], AS_OF, order="seq")


@query("m1_upsert", f"select citation_id, title, province, change from {UPSERT}")
def _(v):
    return _upsert(v)[0].select("citation_id", "title", "province", "change")


@query("m1_upsert_counts", f"select change, count(*) \"count\" from {UPSERT} group by 1")
def _(v):
    return _upsert(v)[1]


@query("m2_upsert_metrics", """select coalesce(o.province, n.province) province, coalesce(o.doc_class, n.doc_class) doc_class, <<d:coalesce(o.evaluation_date, n.evaluation_date)>> evaluation_date,
 <<r:coalesce(n.refusal_accuracy, o.refusal_accuracy)>> refusal_accuracy, case when o.province is null then 'inserted' when n.province is null then 'kept' else 'updated' end change
 from (select * from metric_v where evaluation_date < date '2024-01-08') o full outer join (select province, doc_class, evaluation_date, case when total_queries % 2 = 0 then null else groundedness_score end refusal_accuracy from metric_v
 where evaluation_date > date '2024-01-04') n on o.province = n.province and o.doc_class = n.doc_class and o.evaluation_date = n.evaluation_date""")
def _(v):
    metrics = v("metric_v").select("province", "doc_class", "evaluation_date", "groundedness_score", "refusal_accuracy", "total_queries")
    old = metrics.filter("evaluation_date < date '2024-01-08'").select("province", "doc_class", "evaluation_date", "refusal_accuracy")
    new = metrics.filter("evaluation_date > date '2024-01-04'").select(
        "province", "doc_class", "evaluation_date", F.when(F.col("total_queries") % 2 != 0, F.col("groundedness_score")).alias("refusal_accuracy"))
    return m.upsert_metrics(old, new).select("province", "doc_class", "evaluation_date", "refusal_accuracy", "change")


@query("m3_apply_status", """select j.job_id, coalesce(e.status, j.job_status) job_status, <<t:case when e.status = 'processing' then e.occurred_at end>> started_at,
 <<t:case when e.status in ('completed', 'failed') then e.occurred_at else j.completed_at end>> completed_at
 from job_v j left join (select * from job_event_v qualify row_number() over (partition by job_id order by occurred_at desc, event_id desc) = 1) e on j.job_id = e.job_id""")
def _(v):
    return m.apply_status(v("job_v"), v("job_event_v")).select("job_id", "job_status", "started_at", "completed_at")


@query("m4_mark_superseded", """select citation_id, nullif(first_value(citation_id) over (partition by checksum order by effective_date desc, doc_id desc), citation_id) superseded_by from citation_base""")
def _(v):
    base = v("citation_base")
    table = base.select("citation_id", F.lit(None).cast("string").alias("superseded_by"))
    return m.mark_superseded(table, w.superseded_map(base, ["checksum"], ties=["doc_id"]))


@query("m5_delete_where", "select citation_id from citation_base where not (province = 'guangdong' and citation_id in (select citation_id from citation_base where asset = 'wind'))")
def _(v):
    c = v("citation_base").select("citation_id", "province", "asset")
    return m.delete_where(c, citation_ids=c.filter("asset = 'wind'"), province="guangdong").select("citation_id")


@query("m6_retry_failed", """select job_id, 'retrying' job_status, <<i:retry_count + 1>> retry_count from job_v where job_status = 'failed' and retry_count < max_retries
 and completed_at >= timestamp '1998-06-01 00:00:00' - interval '720' hour""")
def _(v):
    return m.retry_failed(v("job_v"), ORDERS_AS_OF, 720).select("job_id", "job_status", "retry_count")


@query("m7_registry_sync_plan", SYNC_SQL)
def _(v):
    return m.registry_sync_plan(*sync_sides(v), SYNC_COLS)


@query("m8_retention", """select page_id, <<d:cast(fetched_at as date) + 30>> expires_on, fetched_at < timestamp '2024-01-30 00:00:00' - interval '29' day and cast(fetched_at as date) + 30 <= date '2024-01-30' purge from snapshot_v""")
def _(v):
    return m.retention(v("snapshot_v"), AS_OF, 29, 30).select("page_id", "expires_on", "purge")


@query("m9_pack_expiry", """select pack_id, <<t:created_at + interval '7' day>> expires_at, created_at + interval '7' day < timestamp '1998-06-01 00:00:00' is_expired,
 case when created_at + interval '7' day < timestamp '1998-06-01 00:00:00' then 'expired' else pack_status end new_status from pack_v""")
def _(v):
    return m.pack_expiry(v("pack_v"), ORDERS_AS_OF).select("pack_id", "expires_at", "is_expired", "new_status")


@query("m10_cached_packs", """select q.c_custkey, p.pack_id from (select c_custkey, sha256(cast(c_custkey as varchar)) f from customer) q left join (select * from pack_v where pack_status = 'generated' and created_at >= timestamp '1998-06-01 00:00:00' - interval '2400' hour
 qualify row_number() over (partition by query_fingerprint order by created_at desc, pack_id desc) = 1) p on q.f = p.query_fingerprint""")
def _(v):
    questions = v("customer").select("c_custkey", sha256_hex(F.col("c_custkey").cast("string")).alias("query_fingerprint"))
    return m.cached_packs(questions, v("pack_v"), ORDERS_AS_OF, 2400).select("c_custkey", "pack_id")
