"""Running sums, positions, pages and quantiles where one group holds most rows: results and what a task holds."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from regulith.operators import scans, windows
from regulith.streaming import usage

RNG = random.Random(9)


@pytest.fixture(scope="module")
def rows(spark):
    """Nine tenths of 6,000 rows under one key, a null key, ties, null and zero values."""
    data = [(k, "hot" if k % 10 else RNG.choice(["a", "b", None]), RNG.randrange(400), RNG.choice([None, 0, 1, 2.5, 7, 1000 * RNG.random()])) for k in range(6000)]
    return data, spark.createDataFrame([(i, g, t, None if x is None else float(x)) for i, g, t, x in data], "id bigint, g string, t bigint, x double").repartition(8)


def largest_task(cut):
    return cut.groupBy(scans.SEGMENT).count().agg(F.max("count")).first()[0]


def test_slices_are_even_though_a_key_is_hot(spark, rows):
    data, df = rows
    cut = scans.range_segments(df.withColumn("_g", scans.group_key(["g"])), F.col("_g"), F.col("t"), F.col("id"), parts=16)
    assert largest_task(cut) < 2 * len(data) / 16
    summed = scans.running_sums(cut, ["_g"], [F.col("t"), F.col("id")], {"n": F.lit(1), "s": F.col("id")})
    seen = {}
    for i, g, t, _ in sorted(data, key=lambda r: (r[2], r[0])):
        seen.setdefault(g, []).append(i)
    want = {i: (k, sum(ids[:k])) for ids in seen.values() for k, i in enumerate(ids)}
    assert {r.id: (r.n, r.s) for r in summed.collect()} == want


def test_positions_of_the_whole_table(rows):
    data, df = rows
    got = {r.id: r.position for r in scans.positions(df, F.col("t").desc(), F.col("id")).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(data, key=lambda r: (-r[2], r[0])), 1)}


@pytest.mark.parametrize("limit,offset", [(20, 0), (50, 5000), (7, 5997), (10, 6000), (0, 10)])
def test_page(rows, limit, offset):
    data, df = rows
    got = scans.page(df, [F.col("t").desc(), F.col("id")], limit, offset).collect()
    want = sorted(data, key=lambda r: (-r[2], r[0]))[offset : offset + limit]
    assert [(r.id, r.position) for r in got] == [(r[0], offset + n) for n, r in enumerate(want, 1)]


def test_a_page_far_down_moves_only_a_page(spark):
    found = scans.page(spark.range(200_000).withColumn("v", F.hash("id")), [F.col("v"), F.col("id")], 10, 100_000)
    assert len(found.collect()) == 10
    plan = found._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert re.search(r"PartitionFilters: \[[^\]]*_segment#\d+ (IN|=|INSET)|PartitionFilters: \[.*_segment#\d+ (IN|INSET|=)", plan)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_equal_numpy(rows, by):
    data, df = rows
    probs = (0.0, 0.25, 0.5, 0.95, 0.999, 1.0)
    got = {(r.g if by else None): r for r in scans.quantiles(df, "x", by, probs).collect()}
    groups = {}
    for _, g, _, x in data:
        if x is not None:
            groups.setdefault(g if by else None, []).append(float(x))
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        for i, p in enumerate(probs):
            assert got[g][f"q{i}"] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_running_average_and_offsets(rows):
    data, df = rows
    got = {r.id: r.running_avg for r in windows.running_average(df, ["g"], "t", "id", "x").collect()}
    held, want = {}, {}
    for i, g, _, x in sorted(data, key=lambda r: (r[2], r[0])):
        values = held.setdefault(g, [])
        if x is not None:
            values.append(float(x))
        want[i] = float(np.mean(values)) if values else None
    assert set(got) == set(want) and all((got[i] is None) == (w is None) and (w is None or got[i] == pytest.approx(w)) for i, w in want.items())


def test_trailing_use_of_a_hot_key_and_moment(spark):
    data = [(k, "hot" if k % 10 else "b", 1000 if k < 1500 else RNG.randrange(4000)) for k in range(3000)]
    df = spark.createDataFrame(data, "id bigint, k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.used for r in usage.trailing_usage(df, "k", "id", 60, 4).collect()}
    times = {k: np.sort([s for _, g, s in data if g == k]) for k in ("hot", "b")}
    assert got == {i: int(np.searchsorted(times[k], s, "right") - np.searchsorted(times[k], s - 60, "left")) for i, k, s in data}
