"""Session settings that the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the session's shared checkpoint folder; as it is where the session names none."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package; on a cluster it is shipped with --py-files."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    return spark


#: Bytes of a shuffle that one task takes on: keys in order compress to a few bytes a row, and grow again in memory by thirty times and more.
FINE_BYTES = 4 << 20


def finer(spark: SparkSession) -> SparkSession:
    """Keeps shuffles of narrow rows from being merged into few large tasks, in this session."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(FINE_BYTES))
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path that the driver and all executors see: under spark.checkpoint.dir; on a local master without one, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
    return f"{found.rstrip('/')}/quern-{label}-{uuid.uuid4().hex[:12]}"
