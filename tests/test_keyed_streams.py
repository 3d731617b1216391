"""Keyed state on streams that arrive in several batches: late, repeated and stalled events, exact trailing counts, resumed runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from regulith.streaming import keyed, runner, usage

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id bigint, job_id bigint, status string, occurred_at timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def landing(spark, folder, batches, schema):
    """One file a batch, in order of time of arrival."""
    for k, rows in enumerate(batches):
        path = f"{folder}/in/b{k:03d}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


@pytest.fixture(autouse=True)
def rocksdb(spark):
    keyed.use_keyed_state(spark)


BATCHES = [
    [(1, 1, "pending", at(0)), (2, 1, "processing", at(1)), (3, 2, "failed", at(2)), (4, 3, "processing", at(3)), (5, 4, "completed", at(3))],
    [(3, 2, "failed", at(2)), (6, 2, "failed", at(4)), (7, 1, "completed", at(5)), (8, 5, "processing", at(5))],  # 3 is repeated
    [(9, 2, "failed", at(30)), (10, 2, "failed", at(31)), (11, 6, "retrying", at(31))],
    [(12, 7, "processing", at(200))],
    [(14, 5, "completed", at(201)), (15, 8, "pending", at(320)), (13, 3, "pending", at(6))],  # 5 is taken up again; 13 is older than the watermark before: dropped
]


def test_lifecycle_with_late_repeated_and_stalled_events(spark, tmp_path):
    stream = landing(spark, tmp_path, BATCHES, EVENTS)
    got = runner.run_update(keyed.job_lifecycle_stream(stream, 3600, "10 minutes"), ["job_id"], "life", path=str(tmp_path / "out"), within=("seq",))
    state = {r.job_id: (r.status, r.failures, r.updated_at) for r in got.collect()}
    assert state == {
        1: ("completed", 0, at(5)), 2: ("failed", 4, at(31)), 3: ("timed_out", 0, at(3)), 4: ("completed", 0, at(3)), 5: ("completed", 0, at(201)),
        6: ("timed_out", 0, at(31)), 7: ("timed_out", 0, at(200)), 8: ("pending", 0, at(320))}
    kept = spark.createDataFrame([r for b in BATCHES for r in b if r[0] != 13], EVENTS)
    twin = {r.job_id: (r.status, r.failures, r.updated_at) for r in keyed.job_lifecycle(kept, 3600, 600).collect()}
    assert twin == state


def test_lifecycle_resumes_with_its_state(spark, tmp_path):
    out = str(tmp_path / "out")
    stream = landing(spark, tmp_path, BATCHES[:2], EVENTS)
    first = runner.run_update(keyed.job_lifecycle_stream(stream, 3600, "10 minutes"), ["job_id"], "life", path=out, within=("seq",))
    assert {r.job_id: r.failures for r in first.collect()}[2] == 2
    for k in (2, 3, 4):
        spark.createDataFrame(BATCHES[k], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/b{k:03d}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    second = runner.run_update(keyed.job_lifecycle_stream(stream, 3600, "10 minutes"), ["job_id"], "life", path=out, within=("seq",))
    assert {r.job_id: (r.status, r.failures) for r in second.collect()}[2] == ("failed", 4)


def test_trailing_quota_equals_its_batch_twin(spark, tmp_path):
    rows = [(k, "a" if k % 10 else "b", T0 + dt.timedelta(seconds=(k * 37) % 4001)) for k in range(300)]  # nine tenths under one key
    rows.sort(key=lambda r: r[2])
    rows += [(300, "a", rows[-1][2]), (301, "b", rows[-1][2])]
    batches = [rows[i : i + 50] for i in range(0, len(rows), 50)]
    batches[1][0], batches[2][0] = batches[2][0], batches[1][0]  # out of order, within the delay
    schema = "event_id bigint, key string, ts timestamp"
    stream = landing(spark, tmp_path, batches, schema)
    out = runner.run_append(keyed.trailing_quota_stream(stream, "key", "event_id", 60, 4, "15 minutes", per_slice=5), "quota", path=str(tmp_path / "out"))
    got = {(r.event_id, r.used, r.over_quota) for r in out.collect()}
    table = spark.createDataFrame(rows, schema)
    twin = usage.trailing_usage(table, "key", "event_id", 60, 4)
    closed = rows[-1][2] - dt.timedelta(minutes=15)
    want = {(r.event_id, r.used, r.over_quota) for r in twin.where(F.col("ts") < F.lit(closed)).collect()}
    assert got == want and any(r[2] for r in got)
