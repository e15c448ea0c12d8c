"""Each query with an SQL twin gives the twin's rows; all run on empty tables and on tables full of nulls."""

import glob
import math
import os

import duckdb
import pytest

from atrament.plans.catalog import QUERIES, SQL


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.5f}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(data + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = QUERIES[name](spark, data)
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).count() < 10 or name == "synthetic_invoices"  # that one reads no table


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls(spark, nulls, name):
    QUERIES[name](spark, nulls).collect()
