"""Compliance, attribution, cost and quality tables. Verdicts are three-valued: null is neither passed nor failed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), 1)


def pass_table(verdicts: DataFrame, rule: str = "rule", arm: str = "arm", passed: str = "passed") -> DataFrame:
    """rule, arm, passed, scored, pct for each rule and arm, and a total row (rule null) for each arm; one aggregation over grouping sets."""
    return verdicts.groupingSets([[F.col(rule), F.col(arm)], [F.col(arm)]], rule, arm).agg(F.count_if(F.col(passed)).alias("passed"), F.count(passed).alias("scored")).withColumn("pct", percent(F.col("passed"), F.col("scored")))


def attribution(verdicts: DataFrame, by: Sequence[str] = ("rule",)) -> DataFrame:
    """Counts of fixed (passed and fired), alone, not_fixed, missed."""
    p, f = F.col("passed"), F.coalesce(F.col("fired"), F.lit(False))
    return verdicts.where(p.isNotNull()).groupBy(*by).agg(F.count_if(p & f).alias("fixed"), F.count_if(p & ~f).alias("alone"), F.count_if(~p & f).alias("not_fixed"), F.count_if(~p & ~f).alias("missed"))


def spend(ledger: DataFrame, source: Column, day: Column, cost: str) -> DataFrame:
    """source, day, n, total: by source, by day, and over all; null costs count 0."""
    named = ledger.select(source.alias("source"), day.alias("day"), F.coalesce(cost, F.lit(0.0)).alias("cost"))
    return named.groupingSets([[F.col("source")], [F.col("day")], []], "source", "day").agg(F.count("*").alias("n"), F.sum("cost").alias("total"))


def remaining(limit: float, spent: Column) -> Column:
    return F.greatest(F.lit(0.0), limit - spent)


def evaluated(truth: DataFrame, predicted: DataFrame, key: str, actual: str, verdict: str) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall; a missing prediction is a miss."""
    both = truth.join(predicted, key, "left")
    t, v = F.col(actual), F.coalesce(F.col(verdict), F.lit(False))
    n = both.agg(F.count_if(t & v).alias("tp"), F.count_if(~t & v).alias("fp"), F.count_if(t & ~v).alias("fn"), F.count_if(~t & ~v).alias("tn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return n.select("*", F.try_divide(F.col("tp") + F.col("tn"), total).alias("accuracy"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))


def csr(verdicts: DataFrame, key: str, turn: str) -> DataFrame:
    """Per turn: the mean share of checks that pass, and the share of cases in which all do."""
    each = verdicts.groupBy(key, turn).agg(F.avg(F.col("passed").cast("int")).alias("share"), F.min(F.col("passed").cast("int")).alias("every")).where("share IS NOT NULL")
    return each.groupBy(turn).agg(F.avg("share").alias("csr"), F.avg("every").alias("c_isr"), F.count("*").alias("n"))


def rand_index(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two groupings of the same items, from the contingency counts."""
    two = lambda n: n * (n - 1) / 2
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(two(F.col("n"))).alias("x"), F.sum("n").alias("total"))
    left = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("p"))
    right = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("q"))
    joined = both.crossJoin(left).crossJoin(right)  # one row each
    chance = F.col("p") * F.col("q") / two(F.col("total"))
    return joined.select(((F.col("x") - chance) / ((F.col("p") + F.col("q")) / 2 - chance)).alias("ari"))


def hook_verdict(exit_code: Column, decision: Column, go_on: Column, updated: Column) -> Column:
    """Decision table of a hook's answer."""
    return F.when((exit_code == 2) | decision.isin("block", "deny"), "flag").when((exit_code == 0) & ~F.coalesce(go_on, F.lit(True)), "flag").when((exit_code == 0) & updated.isNotNull(), "fix").when(exit_code != 0, "error").otherwise("pass")


def hook_matches(event: Column, on: Column, matcher: Column, tool: Column) -> Column:
    """Whether a hook applies: same event, and an empty matcher, *, or one that matches the tool's whole name."""
    return (event == on) & (F.coalesce(matcher, F.lit("")).isin("", "*") | F.regexp_like(tool, F.concat(F.lit(r"\A(?:"), matcher, F.lit(r")\z"))))


def predicted_calls(items: Column, batch: int, replicates: int, price: float) -> tuple[Column, Column]:
    """(calls, cost) of a model stage before it runs."""
    calls = F.ceil(items / batch) * replicates
    return calls, calls * price
