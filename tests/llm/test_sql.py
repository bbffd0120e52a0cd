"""Operators that SQL can express, against their DuckDB equivalents at the smallest scale."""

import os

import duckdb
import pytest

import quern.llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(quern.llm.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = quern.llm.queries()[name](spark, SF)
    got = con.execute(quern.llm.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, got.fetchall()))
