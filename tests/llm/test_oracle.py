"""Queries that have SQL, against DuckDB on whole tables."""

import duckdb
import pytest

from loomline.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows_as_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(ORACLE[name])
    columns = sorted(want.columns)
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(str(tuple(r[k] for k in place)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql_on_made_up_texts(spark, tmp_path, name):
    long = " ".join(f"w{k % 97}x{k % 89}" for k in range(3000))
    texts = [None, "", " \t\n", "one two", "ONE TWO", "Éner MIT  License x", "apache license version 2 0 apache license version 2 0", "the gnu general public license version 3 mit-license " + long, long, long + " more", "a b c d e " * 40]
    texts += ["permission is hereby granted, free of charge", "charge of free granted hereby is permission", "license mit license mit license"] * 2
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))
