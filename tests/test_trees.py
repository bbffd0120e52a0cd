"""Taxonomies of any depth; fixpoints without bounds."""

import pytest

from quern.operators import trees


def chain(spark, n):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, f"n{i}", 0) for i in range(n)]
    return spark.createDataFrame(rows, "node string, parent string, name string, ord int")


def test_depth(spark):
    assert trees.depth(chain(spark, 1)) == 1 and trees.depth(chain(spark, 23)) == 23
    wide = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("c", "b"), ("s", None)], "node string, parent string")
    assert trees.depth(wide) == 3
    with pytest.raises(ValueError, match="below itself"):
        trees.depth(spark.createDataFrame([("a", "b"), ("b", "a"), ("r", None)], "node string, parent string"))


def test_beam_reaches_the_end_of_a_deep_tree(spark):
    nodes = chain(spark, 15).unionByName(spark.createDataFrame([("x", "n6", "x", 1)], "node string, parent string, name string, ord int"))
    p = spark.createDataFrame([("i", "n7", 0.9), ("i", "x", 0.1)], "item string, node string, p double")
    got = {r["rank"]: (r["path"][-1], len(r["path"])) for r in trees.beam(nodes, p, width=2).collect()}
    assert got == {1: ("n14", 14), 2: ("x", 7)}


def test_closure_of_a_long_path_and_a_cycle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 15), (100, 101)], "src long, dst long")
    got = trees.closure(edges, spark.createDataFrame([(3,), (3,)], "node long"))
    assert sorted(r["node"] for r in got.collect()) == list(range(3, 21))
    assert trees.closure(edges, spark.createDataFrame([(999,)], "node long")).collect()[0]["node"] == 999
