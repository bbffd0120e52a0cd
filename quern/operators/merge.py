"""Deduplication, anti joins and merges of new revisions into stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from quern.session import finer


def one_per_content(files: DataFrame, sha: str, key: str) -> DataFrame:
    """One file for each content, the one of the smallest key, and the number of its copies. One aggregation with map-side combination."""
    rest = [c for c in files.columns if c != sha]
    return files.groupBy(sha).agg(F.min_by(F.struct(*rest), F.col(key)).alias("one"), F.count("*").alias("copies")).select(sha, "one.*", "copies")


def keep_first(df: DataFrame, by: Sequence[Column], order: Sequence[str], most: int = 1) -> DataFrame:
    """The first row (or `most`) of each group; the limit is applied before the shuffle too, so a large group sends little."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def not_yet(files: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among those done."""
    return files.join(done.select(*keys).distinct(), list(keys), "left_anti").select(*files.columns)


def merged(existing: DataFrame, incoming: DataFrame, key: str, group: str, mode: str) -> DataFrame:
    """sync: every stored row of a group that comes in is replaced; append: only unseen keys are added; replace: what comes in."""
    if mode == "sync":
        return existing.join(incoming.select(group).distinct(), group, "left_anti").select(*existing.columns).unionByName(incoming, allowMissingColumns=True)
    if mode == "append":
        return existing.unionByName(incoming.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)
    if mode == "replace":
        return incoming
    raise ValueError(f"mode {mode}: sync, append or replace")


def merge_stats(existing: DataFrame, incoming: DataFrame, key: str, group: str, mode: str) -> DataFrame:
    """kept, replaced, added, total of a merge; one row."""
    out = merged(existing.withColumn("_old", F.lit(1)), incoming.withColumn("_old", F.lit(0)), key, group, mode)
    n = existing.agg(F.count("*").alias("n"))
    return out.agg(F.coalesce(F.sum("_old"), F.lit(0)).cast("long").alias("kept"), F.count("*").alias("total")).crossJoin(n).select("kept", (F.col("n") - F.col("kept")).alias("replaced"), (F.col("total") - F.col("kept")).alias("added"), "total")


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """created, changed and deleted keys of two states of a keyed table."""
    b, a = before.select(F.col(key).alias("k"), F.col(value).alias("v0"), F.lit(1).alias("in0")), after.select(F.col(key).alias("k"), F.col(value).alias("v1"), F.lit(1).alias("in1"))
    kind = F.when(F.col("in0").isNull(), "created").when(F.col("in1").isNull(), "deleted").when(~F.col("v0").eqNullSafe(F.col("v1")), "changed")
    return b.join(a, "k", "full_outer").select(F.col("k").alias(key), kind.alias("change")).where("change IS NOT NULL")


def updated(rows: DataFrame, updates: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Point updates by key: fields that an update leaves null stay."""
    new = updates.select(key, *(F.col(f).alias(f"_new_{f}") for f in fields))
    joined = rows.join(new, key, "left")
    return joined.select(*(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns))


def complete(records: DataFrame, key: str, replicate: str, n: int, error: str = "error") -> DataFrame:
    """Keys that every replicate has without error."""
    return records.where(F.col(error).isNull()).groupBy(key).agg(F.countDistinct(replicate).alias("_n")).where(F.col("_n") == n).select(key)


def reconciled(replies: DataFrame, asked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(replies to take, keys to ask again): a key counts if it was asked and came back exactly once; invented keys are ignored.

    Replies and questions are brought together once, as one group a key: how often it came back, how often it was asked, and its only reply."""
    finer(asked.sparkSession)
    own, others = [c for c in replies.columns if c != key], [c for c in asked.columns if c != key]
    came = replies.select(key, *(F.col(c).alias(f"_r{i}") for i, c in enumerate(own)), F.lit(1).alias("_came"), F.lit(0).alias("_asked"))
    put = asked.select(key, *(F.lit(None).cast(replies.schema[c].dataType).alias(f"_r{i}") for i, c in enumerate(own)), F.lit(0).alias("_came"), F.lit(1).alias("_asked"))
    sums = came.unionByName(put).groupBy(key).agg(F.sum("_came").alias("_came"), F.sum("_asked").alias("_asked"), *(single(replies.schema[c].dataType, f"_r{i}") for i, c in enumerate(own)))
    known = F.col(key).isNotNull() & (F.col("_came") == 1)
    good = sums.where(known & (F.col("_asked") > 0)).select(*(F.col(key) if c == key else F.col(f"_r{own.index(c)}").alias(c) for c in replies.columns))
    if others:
        return good, asked.join(good.select(key), key, "left_anti")
    again = sums.where(~known & (F.col("_asked") > 0))
    return good, again.select(key, F.explode(F.sequence(F.lit(1), F.col("_asked"))).alias("_n")).select(key)


def single(kind: DataType, name: str) -> Column:
    """The value of the only reply of a group: numbers by max, which needs no order of rows; else the first that isn't null."""
    return (F.max(name) if isinstance(kind, NumericType) else F.first(name, ignorenulls=True)).alias(name)


def last_of_each(records: DataFrame, key: str, order: str, error: str | None = None) -> DataFrame:
    """Checkpoint reading: the last record of each key, those with an error dropped first."""
    good = records.where(F.col(error).isNull()) if error else records
    return good.groupBy(key).agg(F.max_by(F.struct(*[c for c in records.columns if c != key]), F.col(order)).alias("_last")).select(key, "_last.*")
