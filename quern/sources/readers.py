"""Readers: parquet, JSON lines, checkpoints, ledgers, files of a project, trees, aliases. Columns and predicates reach the scan."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import merge
from quern.sources import growing, logs

PRUNED = (".git", "node_modules", "__pycache__", ".venv")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,2}\Z")


def read_files(spark: SparkSession, path: str, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """A parquet file or folder; the first rows in a given order where a limit is asked for."""
    df = spark.read.parquet(path)
    return df.orderBy(*order).limit(limit) if limit is not None else df


def read_shards(spark: SparkSession, folder: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """All shards of a folder under the declared schema, older ones lacking columns included; a typed empty table where there are none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    df = spark.read.schema(schema).parquet(f"{folder}/*.parquet") if found is not None and len(found) else spark.createDataFrame([], schema)
    return df.select(*columns) if columns else df


def mapped_columns(df: DataFrame, columns: Mapping[str, str | None], where: str | None = None, defaults: Mapping[str, object] | None = None, order: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """A foreign table under canonical names: columns maps canonical to own name, None where there is none (a default, or null)."""
    defaults = defaults or {}
    out = df.where(F.expr(where)) if where else df
    out = out.select(*(F.col(own).alias(name) if own else F.lit(defaults.get(name)).alias(name) for name, own in columns.items()))
    out = out.orderBy(*order) if order else out
    return out.limit(limit) if limit is not None else out


def probe(df: DataFrame, columns: Mapping[str, str | None]) -> dict:
    """columns, rows, unmapped columns of a table, and mapped ones that it lacks."""
    own = {c for c in columns.values() if c}
    return {"columns": df.columns, "rows": df.count(), "unmapped": [c for c in df.columns if c not in own], "lacking": sorted(own - set(df.columns))}


def read_rules(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rules from a JSON list of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def rules_table(spark: SparkSession, table: str, where: str | None = None, limit: int | None = None, key: str = "clause_id") -> DataFrame:
    """Rules from a table whose name is an identifier and nothing else, in order of their key."""
    if not IDENTIFIER.match(table):
        raise ValueError(f"not a table name: {table}")
    df = spark.table(table)
    df = (df.where(F.expr(where)) if where else df).orderBy(key)
    return df.limit(limit) if limit is not None else df


def json_lines(spark: SparkSession, path: str, schema: str, torn: str = "skip") -> DataFrame:
    """JSON lines: torn ones skipped, or an error. Blank lines are no rows. A glob reads rotated files together."""
    reader = spark.read.schema(schema)
    return reader.option("mode", "DROPMALFORMED" if torn == "skip" else "FAILFAST").json(path)


def checkpoint(spark: SparkSession, path: str, schema: str, key: str, error: str = "error") -> DataFrame:
    """The last good record of each key of an append-only log; torn lines and records with an error are skipped.

    A log written by `writers.append_checkpoint` is ordered by its commits. Other files, which someone else appends to, are ordered by the time of their
    last change, then by name, and within a file by place.
    """
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_claims")
    if fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        return logs.last_records(spark, path, schema, key, error)
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", F.struct(meta["file_modification_time"].alias("t"), meta["file_name"].alias("f"), meta["file_block_start"].alias("b"), F.monotonically_increasing_id().alias("i")).alias("_at"))
    parsed = lines.select(F.from_json("value", schema).alias("r"), "_at").select("r.*", "_at").where(F.col(key).isNotNull())
    return merge.last_of_each(parsed, key, "_at", error if error in parsed.columns else None).drop("_at")


def transcript(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of agent sessions as raw text with time, type and message as JSON; unreadable lines are skipped. Sorting by time is the reader's."""
    lines = spark.read.text(paths)
    fields = F.from_json("value", "timestamp string, type string, uuid string, message string")
    return lines.select(F.col("value").alias("raw"), fields.alias("f")).where("f.type IS NOT NULL OR f.timestamp IS NOT NULL").select("raw", "f.*")


def project_files(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """path, modified, content of a folder's text files: pruned folders and files with a NUL are left out; `since` keeps newer ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if since:
        files = files.where(F.col("modificationTime") >= F.lit(since).cast("timestamp"))
    parts = F.split("path", "/")
    kept = files.where(~F.arrays_overlap(parts, F.array(*map(F.lit, PRUNED))))
    text = kept.withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).where(F.col("text").isNotNull() & (F.instr("text", "\x00") == 0))
    return text.select("path", F.col("modificationTime").alias("modified"), F.col("text").alias("content"))


def markdown_nodes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind, title; edges: src, dst, label) of files (path, content): title line, kind line, `- key: … [x](y.md)` rows."""
    name = F.regexp_extract("path", r"([^/]+)\.md\z", 1)
    lines = files.select(name.alias("id"), F.posexplode(F.split("content", "\n")).alias("line", "own"))
    title = F.min_by(F.regexp_extract("own", r"\A#\s+(.*\S)\s*\z", 1), F.when(F.col("own").rlike(r"\A#\s+\S"), F.col("line")))
    kind = F.min_by(F.regexp_extract("own", r"\Akind:\s*(\S+)", 1), F.when(F.col("own").rlike(r"\Akind:"), F.col("line")))
    nodes = lines.groupBy("id").agg(kind.alias("kind"), title.alias("title"))
    label = F.regexp_extract("own", r"\A-\s+([^:]+):", 1)
    edges = lines.select("id", label.alias("label"), F.explode(F.regexp_extract_all("own", F.lit(r"\]\((?:[^()\s]*/)?([^()/\s]+)\.md\)"), F.lit(1))).alias("dst")).where("label <> ''")
    return nodes, edges.select(F.col("id").alias("src"), "dst", "label")


def tree_nodes(spark: SparkSession, tree: Mapping, descriptions: Mapping[str, str] | None = None) -> DataFrame:
    """A nested taxonomy (a configuration of bounded size) as rows: node, parent, name, path, ord, is_leaf, description (by path, then by name)."""
    descriptions, rows = descriptions or {}, []

    def walk(name: str, inner: Mapping | Sequence | None, parent: str | None, path: list[str], ord_: int) -> None:
        node = "/".join(path)
        kids = list(inner.items()) if isinstance(inner, Mapping) else [x if isinstance(x, tuple) else next(iter(x.items())) if isinstance(x, Mapping) else (x, None) for x in inner or []]
        rows.append((node, parent, name, path, ord_, not kids, descriptions.get(node, descriptions.get(name))))
        for i, (kid, below) in enumerate(kids):
            walk(kid, below, node, [*path, kid], i)

    for i, (name, inner) in enumerate(tree.items()):
        walk(name, inner, None, [name], i)
    return spark.createDataFrame(rows, "node string, parent string, name string, path array<string>, ord int, is_leaf boolean, description string")


def aliases(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """An ordered list of (expression, name) from a JSON list of pairs; a configuration file, read whole."""
    raw = spark.read.text(path, wholetext=True).first()[0]
    return [(a, b) for a, b in json.loads(raw)]


def settings(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hooks, malformed) of settings files (scope order `ord`, path, content): hooks numbered in scope order.

    content: {"hooks": {event: [{"matcher": m, "command": c}]}}; an entry without a command, or a file that is no JSON, is malformed.
    """
    shape = "hooks map<string, array<struct<matcher: string, command: string>>>"
    parsed = files.withColumn("p", F.from_json("content", shape))
    bad = parsed.where("p.hooks IS NULL").select("ord", "path", F.lit("not readable").alias("fault"))
    each = parsed.select("ord", "path", F.explode(F.map_entries("p.hooks")).alias("e")).select("ord", "path", F.col("e.key").alias("event"), F.posexplode("e.value").alias("pos", "h"))
    good = each.where("h.command IS NOT NULL")
    faults = each.where("h.command IS NULL").select("ord", "path", F.concat(F.lit("no command in "), "event").alias("fault"))
    numbered = good.select("ord", "path", "event", "pos", "h.matcher", "h.command")
    return numbered, bad.unionByName(faults)


TASKS = "task_id string, rounds array<struct<round_id: string, query: string, checklist: array<struct<id: string, requirement: string, passed: boolean>>>>"


def tasks(spark: SparkSession, path: str, schema: str = TASKS) -> DataFrame:
    """A task table: JSON lines of tasks, each with its rounds and their checklists nested as they are."""
    return json_lines(spark, path, schema)


def new_lines(spark: SparkSession, folder: str, read: Mapping[str, int] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(path, at, line of what was added to a folder's growing files since the byte offsets `read`; the offsets to keep for next time).

    A half-written last line waits for its end, a file shorter than its offset was cut and is read from its beginning, and only added bytes are read.
    The streaming form, `streams.growing`, leaves the offsets to Spark. They are one number a file, on the driver like the listing.
    """
    growing.register(spark)
    until = growing.ends(folder)
    options = {"path": folder, "since": json.dumps(dict(read or {})), "until": json.dumps(until)}
    return spark.read.format("growing_lines").options(**options).load(), until


def where_clause(*conditions: Column | str | None) -> Column:
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & (F.expr(c) if isinstance(c, str) else c)
    return out
