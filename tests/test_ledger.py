"""One budget for all tasks: never passed by more than the calls in flight, rate kept, lost calls counted."""

import time

import pytest

from quern.operators import ledger, semantic


def ask(spark, own, n, price, partitions=20, cost=None):
    class Priced:
        """A client whose calls take a moment and tell when they began."""

        def answer(self, items):
            began = time.time()
            time.sleep(0.01)
            return [(k, str(began)) for k, _ in items]

    guard = own.guard()
    items = spark.range(0, n, 1, partitions).selectExpr("cast(id as string) k", "'t' t")
    return semantic.asked(items, "k", "t", lambda: semantic.Guarded(Priced(), guard, price, cost), 1)


def test_twenty_tasks_share_a_budget(spark):
    with ledger.Ledger(spark, limit=30.0) as own:
        got = ask(spark, own, 100, 1.0).collect()
        assert len(got) == own.account.calls == 30 and own.account.spent == 30.0 and not own.account.held
        assert ask(spark, own, 5, 1.0, 2).collect() == []


def test_dearer_than_estimated(spark):
    """Four run at once, each costs 3 in place of 1: at most three calls in flight go beyond the limit."""
    with ledger.Ledger(spark, limit=20.0) as own:
        ask(spark, own, 100, 1.0, cost=lambda items, told: 3.0).collect()
        assert 20.0 <= own.account.spent <= 20.0 + 4 * 3.0


def test_a_call_without_a_price_closes_it(spark):
    with ledger.Ledger(spark, limit=1000.0) as own:
        got = ask(spark, own, 60, 1.0, 10, cost=lambda items, told: None).collect()
        assert own.account.unpriced and 1 <= len(got) <= 4


def test_rate_of_all_tasks(spark):
    with ledger.Ledger(spark, limit=1000.0, per_second=10) as own:
        starts = sorted(float(r["answer"]) for r in ask(spark, own, 26, 1.0, 8).collect())
    assert len(starts) == 26 and all(b - a > 0.9 for a, b in zip(starts, starts[10:]))


def test_a_stage_goes_on_where_it_stopped(spark, tmp_path):
    costs = spark.createDataFrame([(4.0,), (None,), (2.0,)], "cost double")
    with ledger.Ledger(spark, limit=10.0, spent=ledger.spent_so_far(costs)) as own:
        guard = own.guard()
        items = spark.range(0, 50, 1, 10).selectExpr("cast(id as string) k", "'t' t")
        path = f"file://{tmp_path}/answers"
        first = semantic.sem_map(items, "k", "t", lambda: semantic.Guarded(semantic.Stub(), guard, 1.0), path, 2)
        assert first.count() == 4 == own.account.spent - 6.0
    with ledger.Ledger(spark, limit=100.0) as own:
        guard = own.guard()
        assert semantic.sem_map(items, "k", "t", lambda: semantic.Guarded(semantic.Stub(), guard, 1.0), path, 2).count() == 50
        assert own.account.spent == 46.0  # what was paid for is not asked again


def test_account_alone():
    own = ledger.Account(5.0, lease=10.0)
    said, one = own.reserve(4.0, 0.0)
    assert said == "ok" and own.reserve(2.0, 1.0)[0] == "wait"  # the first may turn out cheaper
    own.settle(one, 1.0)
    assert own.spent == 1.0
    own.settle(one, 1.0)  # told twice
    assert own.spent == 1.0
    assert own.reserve(3.0, 2.0)[0] == "ok" and own.reserve(1.0, 100.0) == ("ok", 3) and own.spent == 4.0  # the second was lost: counted
    own.settle(2, 0.5)
    assert own.spent == 4.0 and own.reserve(9.0, 101.0)[0] == "wait"
    own.settle(3, 1.0)
    assert own.reserve(0.1, 102.0)[0] == "no"


def test_failed_call_is_counted_and_raised(spark):
    with ledger.Ledger(spark, limit=5.0) as own:
        def broken():
            raise OSError("down")

        with pytest.raises(OSError):
            own.guard().call(2.0, broken)
        assert own.account.spent == 2.0 and not own.account.held
