"""Every registered query against its SQL on the small tables; queries without SQL must give rows."""

import math

import pytest

from regulith.catalog import load
from regulith.sources.adapters import TABLES

QUERIES, ORACLES = load()
# Nothing reaches the default ontology thresholds in synthetic text.
MAY_BE_EMPTY = {"x14_ontology_map_default"}


@pytest.fixture(scope="module")
def duck(data_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{data_dir}/{name}.parquet'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.6f}"
    return str(x)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    got = df.collect()
    if name not in ORACLES:
        assert got or name in MAY_BE_EMPTY
        return
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(got, df.columns) == canonical(cur.fetchall(), columns)


def test_names_are_aligned():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200
