"""Task tables written with their rounds and checks nested, and picks of all tasks kept together."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import finer
from quern.sources import logs, readers

MANIFEST = "name string, folder string, n long"


def nested(tasks: DataFrame, rounds: DataFrame, checks: DataFrame) -> DataFrame:
    """task_id, the tasks' columns, rounds (round_id, query, checklist (id, requirement, passed)); by id at both levels.

    tasks: task_id, …; rounds: task_id, round_id, query; checks: task_id, round_id, id, requirement, passed. A round without checks has an empty list, a task without
    rounds too; rounds without a task and checks without a round are left out."""
    item = F.struct("id", "requirement", "passed")
    lists = checks.groupBy("task_id", "round_id").agg(F.sort_array(F.collect_list(item)).alias("checklist"))
    empty = F.array().cast("array<struct<id: string, requirement: string, passed: boolean>>")
    both = rounds.join(lists, ["task_id", "round_id"], "left").withColumn("checklist", F.coalesce("checklist", empty))
    whole = both.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("round_id", "query", "checklist"))).alias("rounds"))
    none = F.array().cast(whole.schema["rounds"].dataType)
    return tasks.join(whole, "task_id", "left").withColumn("rounds", F.coalesce("rounds", none))


def materialise(tasks: DataFrame, path: str, name: str) -> int:
    """Writes a nested task table as JSON lines and then, in one step, names it in the manifest; how many tasks. Readers see the old table or the new one."""
    spark, folder = tasks.sparkSession, f"data-{uuid.uuid4().hex[:12]}"
    tasks.write.json(f"{path}/{folder}")
    n = spark.read.schema(tasks.schema).json(f"{path}/{folder}").count()
    logs.append(spark.createDataFrame([(name, folder, n)], MANIFEST), f"{path}/manifest")
    return n


def materialised(spark: SparkSession, path: str, name: str, schema: str = readers.TASKS) -> DataFrame:
    """The table that the manifest names last."""
    found = logs.last_records(spark, f"{path}/manifest", MANIFEST, "name").where(F.col("name") == name).first()
    if found is None:
        raise KeyError(f"no task table {name}")
    return readers.tasks(spark, f"{path}/{found['folder']}", schema)


def with_picks(needed: DataFrame, picks: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("rule", "axis")) -> DataFrame:
    """keys, pick, score, fresh: the picks of all that is needed. Those picked before stay (fresh false); the rest take their best candidate, ties by name; null where there
    is none. needed: keys; picks: keys, pick, score; candidates: keys, pick, score."""
    keys = list(keys)
    finer(needed.sparkSession)
    need = needed.select(*keys).distinct()
    old = picks.select(*keys, "pick", "score").join(need, keys, "left_semi").withColumn("fresh", F.lit(False))
    missing = need.join(picks.select(*keys), keys, "left_anti")
    best = candidates.join(missing, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("m"), "pick")).alias("b"))
    new = missing.join(best, keys, "left").select(*keys, F.col("b.pick").alias("pick"), (-F.col("b.m")).alias("score"), F.lit(True).alias("fresh"))
    return old.unionByName(new)
