"""Event sequences: turns, interval joins, stalls, thresholds, permissions over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turns(events: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """Each event with the number of its turn: how many starts came up to it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("turn_no", F.sum(starts.cast("int")).over(w))


def last_text(events: DataFrame, key: str, order: str, starts: Column, speaks: Column, text: str = "text") -> DataFrame:
    """key, turn_no, reply: the last non-empty text of the speaker in each turn; null if it said nothing."""
    said = speaks & (F.trim(F.coalesce(text, F.lit(""))) != "")
    return turns(events, key, order, starts).where("turn_no > 0").groupBy(key, "turn_no").agg(F.max_by(F.when(said, F.col(text)), F.when(said, F.col(order))).alias("reply"))


def in_intervals(events: DataFrame, marks: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Each event with the last mark of its key at or before it (the interval t0 <= t < next t0, the last one open): mark.

    Both sides go into one sorted stream by key and time, marks first at ties: one shuffle, no range comparison of pairs.
    """
    both = events.withColumn("_mark", F.lit(None).cast(marks.schema[tie].dataType)).withColumn("_kind", F.lit(1)).unionByName(marks.select(key, time, F.col(tie).alias("_mark")).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, "_kind", F.coalesce(F.col("_mark"), F.col(tie))).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("mark", F.last("_mark", ignorenulls=True).over(w)).where("_kind = 1").drop("_kind", "_mark")


def stalls(events: DataFrame, key: str, time: str, tie: str, seconds: float) -> DataFrame:
    """Events after which a key was silent for longer."""
    w = Window.partitionBy(key).orderBy(time, tie)
    gap = F.unix_micros(F.lead(time).over(w).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
    return events.withColumn("gap_s", gap / 1e6).where(F.col("gap_s") > seconds)


def crossings(events: DataFrame, key: str, order: Sequence[str], value: str, marks: Sequence[float]) -> DataFrame:
    """key, mark, and the event at which the running sum first reached it; each mark once."""
    w = Window.partitionBy(key).orderBy(*order)
    run = events.withColumn("running", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("_before", F.lag("running").over(w))
    # only events that pass a mark go on; where amounts may be negative a mark is passed again, and the first time counts
    passed = F.filter(F.array(*map(F.lit, marks)), lambda m: (m <= F.col("running")) & (F.col("_before").isNull() | (F.col("_before") < m)))
    hit = run.withColumn("mark", F.explode(passed))
    return hit.groupBy(key, "mark").agg(F.min_by(F.struct(*order, "running"), F.struct(*order)).alias("_at")).select(key, "mark", "_at.*")


def permitted(events: DataFrame, key: str, time: str, tie: str, asks: Column, grants: Column, revokes: Column, minutes: int = 15) -> DataFrame:
    """Requests with whether they are allowed: a grant at most so many minutes before, and no revocation since."""
    w = Window.partitionBy(key).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(time, tie)
    out = events.withColumn("_grant", F.max(F.when(grants, at)).over(w)).withColumn("_revoke", F.max(F.when(revokes, at)).over(w)).withColumn("_asks", asks)
    fresh = F.col(time) <= F.col(f"_grant.{time}") + F.expr(f"INTERVAL {minutes} MINUTES")
    since = F.col("_revoke").isNull() | (F.col("_revoke") < F.col("_grant"))
    return out.where("_asks").withColumn("allowed", F.coalesce(F.col("_grant").isNotNull() & fresh & since, F.lit(False))).drop("_grant", "_revoke", "_asks")


def paired(calls: DataFrame, results: DataFrame, tool: str) -> DataFrame:
    """Calls with their results by id; calls without one keep nulls."""
    return calls.join(results, tool, "left")


def latest(runs: DataFrame, by: Sequence[str], stamp: str) -> DataFrame:
    """The newest run of each group."""
    rest = [c for c in runs.columns if c not in by]
    return runs.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(stamp)).alias("_l")).select(*by, "_l.*")


def with_trailing(lines: DataFrame, key: str, order: str, hit: Column, after: int = 2) -> DataFrame:
    """Lines that hit and the ones after them, once each."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-after, 0)
    return lines.withColumn("_h", F.max(hit.cast("int")).over(w)).where("_h = 1").drop("_h")
