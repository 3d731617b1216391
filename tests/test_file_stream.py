"""Streams over a table that is one file and over one that is a folder of files, as Spark writes it."""

import shutil

import pytest

from regulith.catalog import load
from regulith.streaming import runner


@pytest.fixture
def folders(spark, data_dir, tmp_path):
    """The small tables, with pages and documents as folders of several files."""
    base = tmp_path / "tables"
    shutil.copytree(data_dir, base)
    for name in ("pages", "documents"):
        (base / f"{name}.parquet").unlink()
        spark.read.parquet(f"{data_dir}/{name}.parquet").repartition(3).write.parquet(f"{base}/{name}.parquet")
    return str(base)


def test_files_of_both_layouts_arrive(spark, data_dir, folders):
    for base in (data_dir, folders):
        table = spark.read.parquet(f"{base}/pages.parquet")
        rows = runner.run_append(runner.file_stream(spark, base, "pages.parquet", table.schema), "pages")
        assert sorted(rows.collect()) == sorted(table.collect())


@pytest.mark.parametrize("name", ["t3_dedup_stream", "t7_ingest_sections", "t7_ingest_stream"])
def test_stream_of_a_folder_gives_the_rows_of_the_file(spark, data_dir, folders, name):
    queries, _ = load()
    rows = lambda base: sorted(queries[name](spark, base).collect())
    assert rows(folders) == rows(data_dir)
