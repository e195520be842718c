"""Queries with SQL give the rows that DuckDB gives on the smallest tables."""

import duckdb
import pytest

from blockloom.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), con.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    for df in (got, want):
        df.sort_values(columns, inplace=True, ignore_index=True)
    assert len(got) == len(want)
    for c in columns:
        assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c
