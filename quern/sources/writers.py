"""Writers: sharded parquet, merges with an atomic swap, append checkpoints, reports. One writer at a time for a table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.operators import merge
from quern.sources import logs

ROWS_PER_SHARD = 100_000


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_shards(df: DataFrame, path: str, order: Sequence[str] = (), rows: int = ROWS_PER_SHARD, mode: str = "errorifexists") -> None:
    """zstd parquet of at most so many rows a file, range-partitioned and sorted by `order`; an empty table leaves its schema."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)


def swap(spark: SparkSession, new: str, path: str) -> None:
    """Puts a written folder in the place of a table: the old one stays aside until the new one is there."""
    fs, at = file_system(spark, path)
    fresh, old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex[:8]}")
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"can't move {path}")
    if not fs.rename(fresh, at):
        fs.rename(old, at)
        raise OSError(f"can't move {new}")
    if fs.exists(old):
        fs.delete(old, True)


def insert(incoming: DataFrame, path: str, key: str, group: str, mode: str = "sync", order: Sequence[str] = (), dry_run: bool = False) -> dict:
    """Merges rows into the table at path and returns its figures: kept, replaced, added, total. A dry run only counts."""
    spark = incoming.sparkSession
    fs, at = file_system(spark, path)
    existing = spark.read.parquet(path) if fs.exists(at) else spark.createDataFrame([], incoming.schema)
    stats = merge.merge_stats(existing, incoming, key, group, mode).first().asDict()
    if not dry_run:
        new = f"{path}.new-{uuid.uuid4().hex[:8]}"
        write_shards(merge.merged(existing, incoming, key, group, mode), new, order)
        swap(spark, new, path)
    return stats


def insert_one(spark: SparkSession, row: dict, schema: str, path: str, key: str, group: str) -> dict:
    return insert(spark.createDataFrame([row], schema), path, key, group, "append")


def append_checkpoint(records: DataFrame, path: str) -> int:
    """Finished records appended as a numbered commit, in their order; a failed job's files are not seen."""
    return logs.append(records, path)


COSTS = "source string, model string, cost double, input_tokens long, output_tokens long"


def append_ledger(costs: DataFrame, path: str) -> None:
    """Cost rows (COSTS, and columns of one's own) appended with the time of writing as JSON lines: each job commits
    files of its own, so that writers need no lock between them. A cost that isn't known stays null."""
    missing = [c.split() for c in COSTS.split(", ") if c.split()[0] not in costs.columns]
    rows = costs.withColumns({name: F.lit(None).cast(kind) for name, kind in missing} | {"ts": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")})
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def load_staged(spark: SparkSession, staged: Sequence[str], path: str, key: str) -> int:
    """Appends staged folders one by one, one row a key; rows already there are left out, so loading again after a failure adds nothing twice."""
    n = 0
    for folder in staged:
        rows = spark.read.parquet(folder).dropDuplicates([key])
        fs, at = file_system(spark, path)
        new = merge.not_yet(rows, spark.read.parquet(path), [key]) if fs.exists(at) else rows
        seen = Observation()
        new.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)  # counted as it is written
        n += seen.get["n"]
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)
    return n


def create_table(spark: SparkSession, name: str, ddl: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet")


def export_json(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A JSON list in order, for people: the text is put together on the driver row by row, not held."""
    ordered = df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(ordered.toLocalIterator()):
            f.write((",\n " if i else "\n ") + r["j"])
        f.write("\n]\n")


def write_run(df: DataFrame, path: str, metadata: dict, **tables: DataFrame) -> None:
    """A run's result as JSON lines, with what describes the run and its other tables (rules, subcategories, classes) beside it."""
    spark = df.sparkSession
    for name, table in {"result": df, **tables}.items():
        table.write.mode("overwrite").json(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/run")
