"""Replies and picks of large tables: one sort or hash of each side, no joins between copies of it."""

import io
from contextlib import redirect_stdout

from quern.operators import merge, tasks


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_reconciled_in_one_group(spark):
    replies = spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (2, "c", 2.5), (None, "d", 1.0), (7, "e", 1.0), (3, None, None)], "k long, word string, n double")
    asked = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,), (None,)], "k long")
    good, again = merge.reconciled(replies, asked, "k")
    assert sorted(map(tuple, good.collect())) == [(1, "a", 1.5), (3, None, None)] and good.columns == ["k", "word", "n"]
    assert sorted((r["k"] for r in again.collect()), key=lambda k: (k is None, k)) == [2, 2, 4, None]
    assert "Join" not in plan(good) + plan(again)
    more = asked.selectExpr("k", "k * 2 AS twice")
    assert sorted((r["k"], r["twice"]) for r in merge.reconciled(replies, more, "k")[1].where("k > 0").collect()) == [(2, 4), (2, 4), (4, 8)]


def test_picks_keep_shuffles_fine(spark):
    """Whose narrow rows Spark's default would merge into tasks of 64 MB, compressed."""
    from quern.session import FINE_BYTES

    at = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.unset(at)
    needed = spark.createDataFrame([(1, "a"), (2, "a")], "rule long, axis string")
    picks = spark.createDataFrame([(1, "a", "x", 5)], "rule long, axis string, pick string, score long")
    got = tasks.with_picks(needed, picks, picks.selectExpr("rule + 1 AS rule", "axis", "pick", "score"))
    assert int(spark.conf.get(at)) == FINE_BYTES
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x", 5, False), (2, "a", "x", 5, True)]
