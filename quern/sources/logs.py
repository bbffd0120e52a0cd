"""Append-only logs that keep the order of appends: numbered commits, the last record of each key, snapshots that shorten reading.

A log is a folder. An append claims the next number by creating the claim's file, which fails where another writer was quicker, and
writes its lines as commit=<number>; Spark's _SUCCESS file makes the commit visible, so a job that fails leaves a number unused and nothing to
read. Records are ordered by (commit, file, place in the file), whatever the files' names and times: the order in which appends began, and
within one the order of its rows. A snapshot holds the last record of each key of the commits it names, each with its own place, so that a commit that
began before the snapshot and ended after it still takes its turn.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import merge

PLACE = "_at struct<commit: long, file: string, block: long, row: long>"


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str, prefix: str) -> Iterator[int]:
    fs, at = _path(spark, path)
    if fs.exists(at):
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name.startswith(prefix) and name[len(prefix) :].isdigit():
                yield int(name[len(prefix) :])


def claimed(spark: SparkSession, path: str) -> int:
    """A number higher than all claimed before; no two writers get the same."""
    n = max(_numbers(spark, f"{path}/_claims", ""), default=0) + 1
    while not _created(spark, f"{path}/_claims/{n:012d}"):
        n += 1
    return n


def _created(spark: SparkSession, path: str) -> bool:
    """Whether this call has created the file. HDFS creates exclusively; Hadoop's local file system looks first and then creates, so a local (or mounted) path is left to the
    operating system."""
    fs, at = _path(spark, path)
    if fs.getScheme() == "file":
        fs.mkdirs(at.getParent())
        try:
            os.close(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return True
        except FileExistsError:
            return False
    try:
        fs.create(at, False).close()
        return True
    except Py4JJavaError:
        if not fs.exists(at):
            raise
        return False


def append(records: DataFrame, path: str) -> int:
    """Appends the rows, in their order, as JSON lines; the commit's number."""
    n = claimed(records.sparkSession, path)
    records.write.mode("errorifexists").json(f"{path}/commit={n:012d}")
    return n


def _covered(spark: SparkSession, path: str, number: int) -> list[int]:
    return [int(r[0]) for r in spark.read.text(f"{path}/snapshot={number:012d}/covers").collect()]


def _complete(spark: SparkSession, path: str, kind: str) -> list[int]:
    def done(n: int) -> bool:
        fs, at = _path(spark, f"{path}/{kind}={n:012d}/_SUCCESS")
        return fs.exists(at)

    return sorted(n for n in _numbers(spark, path, f"{kind}=") if done(n))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and _at (PLACE) of all lines that count: those of the last snapshot and of the commits that it doesn't cover."""
    commits, snapshots = _complete(spark, path, "commit"), _complete(spark, path, "snapshot")
    covered = set(_covered(spark, path, snapshots[-1])) if snapshots else set()
    folders = [f"{path}/commit={n:012d}" for n in commits if n not in covered]
    out = spark.read.schema(f"value string, {PLACE}").parquet(f"{path}/snapshot={snapshots[-1]:012d}/rows") if snapshots else spark.createDataFrame([], f"value string, {PLACE}")
    if folders:
        meta = F.col("_metadata")
        commit = F.regexp_extract(meta["file_path"], r"/commit=(\d+)/[^/]*\z", 1).cast("long")
        at = F.struct(commit.alias("commit"), meta["file_name"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))
        out = out.unionByName(spark.read.option("recursiveFileLookup", True).text(folders).select("value", at.alias("_at")))
    return out


def last_records(spark: SparkSession, path: str, schema: str, key: str, error: str = "error") -> DataFrame:
    """The last good record of each key; torn lines, records without the key and records with an error are skipped."""
    parsed = lines(spark, path).select(F.from_json("value", schema).alias("r"), "_at").select("r.*", "_at").where(F.col(key).isNotNull())
    return merge.last_of_each(parsed, key, "_at", error if error in parsed.columns else None).drop("_at")


def snapshot(spark: SparkSession, path: str, key: str, error: str = "error") -> int:
    """Writes the last good record of each key of all complete commits; reading then begins there. The commits stay until `vacuum`."""
    covers = _complete(spark, path, "commit")
    own = lines(spark, path).withColumns({"_key": F.get_json_object("value", f"$.{key}"), "_bad": F.get_json_object("value", f"$.{error}")})
    rows = merge.last_of_each(own.where("_key IS NOT NULL AND _bad IS NULL"), "_key", "_at").select("value", "_at")
    n = claimed(spark, path)
    rows.write.parquet(f"{path}/snapshot={n:012d}/rows")
    earlier = [x for s in _complete(spark, path, "snapshot") for x in _covered(spark, path, s)]
    spark.createDataFrame([(str(x),) for x in sorted({*covers, *earlier})], "value string").coalesce(1).write.text(f"{path}/snapshot={n:012d}/covers")
    fs, at = _path(spark, f"{path}/snapshot={n:012d}/_SUCCESS")
    fs.create(at, True).close()
    return n


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes commits that the last snapshot covers, and snapshots before it; how many. Only where no reader of the older state is left."""
    snapshots = _complete(spark, path, "snapshot")
    if not snapshots:
        return 0
    gone = [f"commit={n:012d}" for n in _covered(spark, path, snapshots[-1])] + [f"snapshot={n:012d}" for n in snapshots[:-1]]
    removed = 0
    for name in gone:
        fs, at = _path(spark, f"{path}/{name}")
        removed += fs.exists(at) and fs.delete(at, True)
    return removed

