"""Every registered query against its DuckDB equivalent at the smallest scale, and without one: it runs and its rows are whole."""

import os

import duckdb
import pytest

from quern.plans import catalogue

SF = os.environ.get("QUERN_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(found):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(tuple(r) for r in df.select(*columns).collect()) == rows(got.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("name", ["l5_vote_plan", "j13_interval", "a32_duplicate_counts", "l9_beam", "w10_thresholds"])
def test_partitioning_does_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(rows(tuple(r) for r in catalogue.queries()[name](spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_own_prose_two_ways(spark):
    got = catalogue.queries()["m9_own_prose"](spark, SF).collect()
    assert got and all(r["prose"].split() == r["masked"].split() for r in got)
