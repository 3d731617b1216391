"""Merging by partition: untouched files stay as they are, runs resume, repeated batches change nothing, emptied partitions go."""

import datetime as dt
import hashlib
import pathlib

from pyspark.sql import functions as F

from regulith.operators import parted
from regulith.streaming import runner

AS_OF, LATER = dt.datetime(2024, 1, 30), dt.datetime(2024, 2, 1)
ROWS = "chunk_id string, doc_id bigint, content string"


def files(target):
    return {str(p): hashlib.md5(p.read_bytes()).hexdigest() for p in pathlib.Path(target).rglob("*.parquet")}


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def state(spark, target):
    return {r.chunk_id: (r.content, r.change, r.updated_at) for r in spark.read.parquet(target).collect()}


def merge(target, df, **more):
    parted.merge_into(target, df, ["chunk_id"], ["doc_id", "content"], "doc_id", more.pop("as_of", AS_OF), "content", **more)


def test_only_touched_partitions_are_written(spark, tmp_path):
    target = str(tmp_path / "t")
    merge(target, table(spark, [(f"c{k}", k, f"text {k}") for k in range(200)]))
    before = files(target)
    merge(target, table(spark, [("c7", 7, "new"), ("c7", 7, "newer"), ("d7", 7, "more")]), as_of=LATER, batch=1)
    after = files(target)
    number = spark.range(1).select(parted.part_of(F.lit(7).cast("bigint"), 16)).first()[0]
    assert {p for p in before if f"part={number}/" not in p} == {p for p in after if f"part={number}/" not in p}
    assert all(after[p] == h for p, h in before.items() if f"part={number}/" not in p)
    got = state(spark, target)
    assert got["c7"] == ("newer", "updated", LATER) and got["d7"] == ("more", "inserted", LATER) and got["c8"] == ("text 8", "inserted", AS_OF)
    assert len(got) == 201


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    target = str(tmp_path / "t")
    merge(target, table(spark, [("a", 1, "x"), ("b", 2, "y")]))
    batch = table(spark, [("a", 1, "x2"), ("c", 1, "z")])
    merge(target, batch, as_of=LATER, batch=1)
    once = state(spark, target)
    merge(target, batch, as_of=LATER, batch=1)
    assert state(spark, target) == once == {"a": ("x2", "updated", LATER), "b": ("y", "inserted", AS_OF), "c": ("z", "inserted", LATER)}


def test_rows_of_an_owner_are_replaced_and_emptied_partitions_go(spark, tmp_path):
    target = str(tmp_path / "t")
    merge(target, table(spark, [("a", 1, "x"), ("b", 1, "y"), ("c", 2, "z")]), parts=1000)
    owners = spark.createDataFrame([(1,), (2,), (9,)], "doc_id bigint")
    merge(target, table(spark, [("a", 1, "x2")]), parts=1000, owners=owners, batch=1)
    assert {k: v[0] for k, v in state(spark, target).items()} == {"a": "x2"}
    assert len(list(pathlib.Path(target).glob("part=*"))) == 1


def test_deletion_by_owner_and_criteria(spark, tmp_path):
    target = str(tmp_path / "t")
    merge(target, table(spark, [(f"c{k}", k % 5, "x") for k in range(20)]))
    parted.delete_from(target, spark.createDataFrame([(1,)], "doc_id bigint"), "doc_id", spark)
    assert {r.doc_id for r in spark.read.parquet(target).collect()} == {0, 2, 3, 4}
    parted.delete_from(target, spark.createDataFrame([(2,)], "doc_id bigint"), "doc_id", spark, chunk_ids=spark.createDataFrame([("c7",), ("c3",)], "chunk_id string"))
    left = {r.chunk_id for r in spark.read.parquet(target).collect()}
    assert "c7" not in left and {"c2", "c12", "c17", "c3"} <= left


def arrivals(spark, folder):
    schema = "doc_id bigint, text string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{folder}/in/{name}")


def lines(batch):
    return batch.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content")).withColumn("chunk_id", F.concat_ws(":", "doc_id", "pos"))


def ingest(spark, folder):
    return runner.ingest_stream(arrivals(spark, folder), lines, f"{folder}/table", ["chunk_id"], ["doc_id", "content"], AS_OF, "content", "doc_id")


def test_ingest_resumes_where_it_stands(spark, tmp_path):
    land(spark, tmp_path, "a", [(k, f"one {k}\ntwo {k}") for k in range(30)])
    assert ingest(spark, tmp_path).count() == 60
    before = files(tmp_path / "table")
    assert ingest(spark, tmp_path).count() == 60 and files(tmp_path / "table") == before  # nothing new: nothing is written
    land(spark, tmp_path, "b", [(3, "only"), (40, "a\nb\nc")])
    got = {(r.doc_id, r.content) for r in ingest(spark, tmp_path).collect()}
    assert len(got) == 60 - 2 + 1 + 3 and (3, "only") in got and (3, "two 3") not in got
    same = [p for p, h in files(tmp_path / "table").items() if before.get(p) == h]
    assert len(same) >= len(before) - 2


def test_seen_checksums_are_dropped_across_batches_runs_and_time(spark, tmp_path):
    land(spark, tmp_path, "a", [(1, "x"), (2, "x"), (3, "y"), (4, None)])
    target = f"{tmp_path}/seen"
    dedup = lambda run: {(r.doc_id, r.text, r.run) for r in runner.dedup_stream(arrivals(spark, tmp_path), target, "text", ["doc_id"], run).collect()}
    assert dedup("one") == {(1, "x", "one"), (3, "y", "one")}
    land(spark, tmp_path, "b", [(5, "y"), (6, "z")])
    assert dedup("one") == {(1, "x", "one"), (3, "y", "one"), (6, "z", "one")}
    before = files(target)
    assert len(dedup("two")) == 3 and files(target) == before  # another stream over the same files finds all stored


def test_a_repeated_batch_of_keys_is_stored_once(spark, tmp_path):
    target = f"{tmp_path}/seen"
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id bigint, text string")
    for _ in range(2):
        parted.append_unseen(target, rows, "text", [F.col("doc_id")], "r", 0)
    assert spark.read.parquet(target).count() == 2


def test_first_rows_are_written_once(spark, tmp_path, monkeypatch):
    """Partitions the table does not have are moved into it; with repeated keys, or rows there, the merge runs."""
    ran = []
    plain = parted._replace
    monkeypatch.setattr(parted, "_replace", lambda *a: ran.append(a) or plain(*a))
    target = str(tmp_path / "t")
    merge(target, table(spark, [(f"c{k}", k, f"text {k}") for k in range(100)]))
    assert not ran and len(state(spark, target)) == 100 and set(state(spark, target).values()) == {(f"text {k}", "inserted", AS_OF) for k in range(100)}
    merge(target, table(spark, [("c7", 7, "new")]), as_of=LATER, batch=1)
    assert len(ran) == 1 and state(spark, target)["c7"] == ("new", "updated", LATER)
    merge(str(tmp_path / "u"), table(spark, [("c7", 7, "a"), ("c7", 7, "b")]))
    assert len(ran) == 2 and state(spark, str(tmp_path / "u")) == {"c7": ("b", "inserted", AS_OF)}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t", "u"]
