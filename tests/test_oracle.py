"""Every query with an SQL equivalent gives the same rows as DuckDB at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tarnwell import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def key(row):
    return tuple((v is None, str(v)) for v in row)


def same(spark, con, name, query, sql):
    df = query(spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(x[i]) for i in at) for x in rel.fetchall()), key=key)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_core(spark, con, name):
    same(spark, con, name, registry.queries()[name], registry.oracle_sql()[name])


ROWS_ONLY = sorted(set(registry.queries()) - set(registry.oracle_sql()))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
