"""Units kept by content and grammar version: what hasn't changed isn't cut again.

A store is a folder with units (a folder for each cut, written once) and a manifest of (sha, version, part). A content is cut for a version once, however
many documents have it; a document's units are found by its content. A new version of the grammar cuts all contents that are asked for anew, beside the older ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources import logs

MANIFEST = "sha string, version string, part string"


def manifest(docs: DataFrame, store: str) -> DataFrame:
    """sha, version, part of all contents cut so far. A cut counts once its commit is complete."""
    lines = logs.lines(docs.sparkSession, f"{store}/manifest")
    return lines.select(F.from_json("value", MANIFEST).alias("m")).select("m.*")


def recut(docs: DataFrame, store: str, version: str, cut: Callable[[DataFrame], DataFrame], text: str = "text") -> int:
    """Cuts the contents of docs that the store lacks in this version; how many. cut: (sha, text) -> sha, idx and columns of units."""
    spark = docs.sparkSession
    content = docs.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = manifest(docs, store).where(F.col("version") == version).select("sha")
    # of equal contents one text goes on; a left anti join first, so that nothing known is gathered
    new = content.join(known, "sha", "left_anti").groupBy("sha").agg(F.first("text").alias("text"))
    part = uuid.uuid4().hex[:12]
    new.write.parquet(f"{store}/contents/{part}")
    todo = spark.read.parquet(f"{store}/contents/{part}")
    n = todo.count()
    if n:
        cut(todo).write.parquet(f"{store}/units/{part}")
        logs.append(todo.select("sha", F.lit(version).alias("version"), F.lit(part).alias("part")), f"{store}/manifest")
    return n


def units(docs: DataFrame, store: str, version: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, part (the cut that made them) and the units' columns for each document, as they are stored for its content in this version."""
    held = manifest(docs, store).where(F.col("version") == version).groupBy("sha").agg(F.min("part").alias("part"))
    parts = [r["part"] for r in held.select("part").distinct().collect()]  # one a cut
    own = docs.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha")).join(held, "sha")
    spark = docs.sparkSession
    stored = None
    for p in parts:
        one = spark.read.parquet(f"{store}/units/{p}").withColumn("part", F.lit(p))
        stored = one if stored is None else stored.unionByName(one, allowMissingColumns=True)
    return own.join(stored, ["sha", "part"]) if stored is not None else own
