"""Every registered query that has SQL, against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomline import registry

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    want = duck.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert [KINDS[t] for _, t in df.dtypes] == [str(want.types[k]) for k in order]
    got = sorted(tuple(map(plain, r)) for r in df.collect())
    assert got == sorted(tuple(plain(r[k]) for k in order) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
