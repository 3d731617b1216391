"""Keyed state on a stream: job life-cycles that time out, and exact trailing quotas. Each has a batch twin.

State lives in the state store of the stream's checkpoint, one small state per key; timers are in event time, so what a
key holds is given up when the watermark has passed it. The processors are pickled by value with their tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FINAL = ("completed", "failed")  # a job in another state may stall
JOB = "job_id bigint, status string, failures bigint, updated_at timestamp, seq bigint"


class Lifecycle(StatefulProcessor):
    """Latest status and failures of one job. Failed events are counted once by id; ids are kept until the watermark drops repeats."""

    def __init__(self, timeout_ms: int, max_retries: int):
        self.timeout_ms, self.max_retries = timeout_ms, max_retries

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "at bigint, event bigint, status string, failures bigint, seq bigint")
        self.seen = handle.getMapState("failed", "event bigint", "at bigint")

    def _row(self, key, state) -> pd.DataFrame:
        at, event, status, failures, seq = state
        self.state.update((at, event, status, failures, seq + 1))
        shown = "pending" if status == "failed" and failures <= self.max_retries else status
        return pd.DataFrame({"job_id": [key[0]], "status": [shown], "failures": [failures], "updated_at": [pd.Timestamp(at, unit="us")], "seq": [seq + 1]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        state = tuple(self.state.get()) if self.state.exists() else (-(1 << 62), 0, "", 0, 0)
        failed = got[got["status"] == "failed"].drop_duplicates("event_id")
        new = [(int(e), int(at)) for e, at in zip(failed["event_id"], failed["us"]) if not self.seen.containsKey((int(e),))]
        for event, at in new:
            self.seen.updateValue((event,), (at,))
        last = got.sort_values(["us", "event_id", "status"]).iloc[-1]
        best = max(state[:3], (int(last["us"]), int(last["event_id"]), last["status"]))
        state = (*best, state[3] + len(new), state[4])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(best[0] // 1000 + self.timeout_ms)
        yield self._row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, event, status, failures, seq = tuple(self.state.get())
        low = timerValues.getCurrentWatermarkInMs() * 1000
        for (event_id,), (seen_at,) in list(self.seen.iterator()):
            if seen_at < low:
                self.seen.removeKey((event_id,))
        retried = status == "failed" and failures <= self.max_retries
        if status != "timed_out" and (status not in FINAL or retried):
            yield self._row(key, (at, event, "timed_out", failures, seq))


def job_lifecycle_stream(events: DataFrame, timeout_seconds: int, delay: str, max_retries: int = 3) -> DataFrame:
    """(job_id, status, failures, updated_at, seq) at each change of a job; of a job's rows the one of largest seq holds.

    ``events`` (job_id, event_id, status, occurred_at) may come in any order and more than once. Events older than the
    watermark are dropped. A job that is not done and has no event for the timeout becomes ``timed_out``; a later event
    takes it up again. In update mode; the session needs the RocksDB state store (``use_keyed_state``).
    """
    rows = events.withWatermark("occurred_at", delay).select("job_id", "event_id", "status", "occurred_at", F.unix_micros("occurred_at").alias("us"))
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=Lifecycle(timeout_seconds * 1000, max_retries), outputStructType=JOB, outputMode="Update", timeMode="EventTime")


def job_lifecycle(events: DataFrame, timeout_seconds: int, delay_seconds: int, max_retries: int = 3) -> DataFrame:
    """The batch twin: the state after all events, with the watermark that they give."""
    once = events.groupBy("job_id", "event_id", "status", "occurred_at").agg(F.lit(1).alias("_one"))
    folded = once.groupBy("job_id").agg(
        F.max(F.struct("occurred_at", "event_id", "status")).alias("m"), F.count_if(F.col("status") == "failed").alias("failures"))
    watermark = events.agg(F.max(F.unix_micros("occurred_at")) - F.lit(delay_seconds * 1_000_000)).scalar()
    shown = F.when((F.col("m.status") == "failed") & (F.col("failures") <= max_retries), "pending").otherwise(F.col("m.status"))
    overdue = F.unix_micros("m.occurred_at") + F.lit(timeout_seconds * 1_000_000) < watermark
    status = F.when(overdue & ~shown.isin(*FINAL), "timed_out").otherwise(shown)
    return folded.select("job_id", status.alias("status"), "failures", F.col("m.occurred_at").alias("updated_at"))


class Trailing(StatefulProcessor):
    """The rows of one slice of a key that are not counted yet or that later rows may count."""

    def __init__(self, reach_us: int, limit: int):
        self.reach_us, self.limit = reach_us, limit

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "us bigint, tie bigint, own boolean")

    def _settle(self, key, held: list[tuple], watermark_us: int) -> Iterator[pd.DataFrame]:
        """Emit rows that the watermark has passed; keep the others and those within their reach."""
        us = np.array([r[0] for r in held], np.int64)
        tie, own = np.array([r[1] for r in held], np.int64), np.array([r[2] for r in held], bool)
        order = np.lexsort((tie, us))
        us, tie, own = us[order], tie[order], own[order]
        closed = own & (us < watermark_us)
        used = np.searchsorted(us, us, side="right") - np.searchsorted(us, us - self.reach_us, side="left")
        waiting = own & ~closed
        low = min(int(us[waiting][0]) if waiting.any() else 1 << 62, watermark_us) - self.reach_us
        rest = us >= low
        own &= ~closed
        if rest.any():
            self.rows.put([(int(a), int(b), bool(c)) for a, b, c in zip(us[rest], tie[rest], own[rest])])
        else:
            self.rows.clear()
        if waiting.any():
            self.handle.registerTimer(int(us[waiting][0]) // 1000 + 1)
        elif rest.any():
            self.handle.registerTimer((int(us[-1]) + self.reach_us) // 1000 + 1)  # nothing waits: give the state up then
        if closed.any():
            yield pd.DataFrame({"key": key[0], "tie": tie[closed], "ts": pd.to_datetime(us[closed], unit="us"), "used": used[closed], "over_quota": used[closed] > self.limit})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        held += list(zip(got["us"].tolist(), got["tie"].tolist(), got["own"].tolist()))
        yield from self._settle(key, held, max(0, timerValues.getCurrentWatermarkInMs()) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.rows.exists():
            yield from self._settle(key, [tuple(r) for r in self.rows.get()], timerValues.getCurrentWatermarkInMs() * 1000)


def _sliced(events: DataFrame, key: str, tie: str, ts: str, seconds: int, per_slice: int) -> DataFrame:
    """Rows by slice of time, those near the end of a slice also as context of the next: a hot key has many states."""
    us = F.unix_micros(ts)
    width, reach = seconds * per_slice * 1_000_000, seconds * 1_000_000
    own = F.floor(us / width)
    copies = F.when((own + 1) * width - us <= reach, F.array(own, own + 1)).otherwise(F.array(own))
    rows = events.select(F.col(key).alias("key"), F.col(tie).cast("bigint").alias("tie"), ts, us.alias("us"), own.alias("_own"), F.explode(copies).alias("slice"))
    return rows.withColumn("own", F.col("slice") == F.col("_own")).drop("_own")


def trailing_quota_stream(events: DataFrame, key: str, tie: str, seconds: int, limit: int, delay: str, ts: str = "ts", per_slice: int = 60) -> DataFrame:
    """Requests of the key in the ``seconds`` up to each request, exactly, once the watermark has passed it.

    Rows (key, tie, ts, used, over_quota) as of ``usage.trailing_usage``. Append mode. A state holds one slice of a key, its
    rows no longer than the window behind the watermark.
    """
    rows = _sliced(events.withWatermark(ts, delay), key, tie, ts, seconds, per_slice)
    counted = rows.groupBy("key", "slice").transformWithStateInPandas(
        statefulProcessor=Trailing(seconds * 1_000_000, limit), outputStructType="key string, tie bigint, ts timestamp, used bigint, over_quota boolean",
        outputMode="Append", timeMode="EventTime")
    return counted.toDF(key, tie, ts, "used", "over_quota")


def use_keyed_state(spark) -> None:
    """Keyed state needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
