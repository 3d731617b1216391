"""The pipeline's stages against plain versions on the small tables, and the registered queries against their SQL."""

import inspect

import plain
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from regulith.llm import queries

NAMES = ["op1_decontaminate", "op2_toxicity", "op3_quality_rules", "op4_suffix_dedup", "op5_packing", "op6_perplexity", "op7_block_dedup", "op8_minhash", "op9_archive", "op10_line_templates", "op11_mixing", "op12_lexical_search", "op13_hard_negatives"]


@pytest.fixture(scope="module")
def staged(spark, data_dir, tmp_path_factory):
    """Input and output of each stage, as they are written."""
    docs, out = spark.read.parquet(f"{data_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, data_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_stay(staged):
    for name, (before, after) in staged.items():
        assert before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name != "packing":
            assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_toxicity_stage(staged, spark, data_dir):
    before, after = staged["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{data_dir}/labels.parquet").where("toxic = 1").collect()}
    gone = set(texts(before)) - set(texts(after))
    clean = {r.doc_id for r in spark.read.parquet(f"{data_dir}/labels.parquet").where("toxic = 0").collect()}
    assert not gone & clean
    assert all(texts(before)[k] == t for k, t in texts(after).items()) and toxic


def test_line_stage(staged):
    before, after = staged["line_dedup"]
    old, new = texts(before), texts(after)
    assert set(old) == set(new)
    for k, t in old.items():
        lines = iter(t.split("\n"))
        assert new[k] == "" or all(x in lines for x in new[k].split("\n"))  # in order
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0


def test_near_stage(staged):
    before, after = staged["near_dedup"]
    old = texts(before)
    want = plain.near_classes(old.items(), 5, 80)
    assert texts(after) == {k: t for k, t in old.items() if want[k][2]}


def test_decontamination_stage(staged, spark, data_dir):
    before, after = staged["decontamination"]
    items = [plain.folded(r.text) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    dirty = {k for k, t in texts(before).items() if any(i in plain.folded(t) for i in items)}
    gone = set(texts(before)) - set(texts(after))
    assert dirty <= gone
    for k in gone - dirty:  # none in these tables is far from an item
        assert any(plain.least_edits(i, plain.folded(texts(before)[k])) <= 0.08 * len(i) for i in items)


def test_packing_stage(staged):
    before, after = staged["packing"]
    size = {k: len(plain.WORD.findall(t)) for k, t in texts(before).items()}
    assert {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()} == size
    assert after.where("bin_id is not null").groupBy("bin_id").agg(F.sum("n_words").alias("n")).where("n > 2048").count() == 0


def test_run_is_the_stages(spark, data_dir, staged):
    key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert key(corpus_pipeline.run(spark, data_dir).collect()) == key(staged["packing"][1].collect())


def test_all_are_registered():
    assert [n for n in queries.QUERIES if n.startswith("op")] and set(NAMES) | {"pipeline"} == set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert "localCheckpoint" not in inspect.getsource(queries)


def cell(x):
    return str(int(x)) if isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, data_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{data_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data_dir)
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in sorted(columns)) for r in df.collect())
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert got == sorted(tuple(cell(r[i]) for i in order) for r in found.fetchall())
