"""Streaming forms: incremental sources, first alerts, status, sliding and session windows; operators with state and timers are in `timers`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import growing as source


def tail(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines as files arrive; what was read is kept in the query's checkpoint, so a restart reads nothing twice."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(folder)


def growing(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """path, at, line of files that others append to: byte offsets in the query's checkpoint, whole lines only."""
    source.register(spark)
    return spark.readStream.format("growing_lines").option("path", folder).option("suffix", suffix).load()


def first_alerts(events: DataFrame, keys: Sequence[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once; the state is dropped after the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def status(events: DataFrame, time: str, kind: str, every: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by kind in tumbling windows."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), kind, "n")


def sliding(events: DataFrame, time: str, kind: str, size: str, slide: str, late: str = "1 hour") -> DataFrame:
    """start, kind, n: counts by kind in windows of a size that begin every slide; a window shows once the watermark has passed its end, without later events."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, size, slide).alias("w"), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), kind, "n")


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """key, start, end, n: a key's events without a pause of the gap between them; end is the last event and the gap. A late event that
    is not later than the watermark may still join two sessions, so one shows once the watermark has passed its end."""
    found = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that is there now, appended to parquet at path; running it again takes only what is new."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def merge_batches(stream: DataFrame, merge, checkpoint: str) -> None:
    """Each micro-batch through a batch function (df, batch id), which must be safe to repeat."""
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
