"""Queries that run as streams: the events arrive in slices of time, each taken by a restart of the query from its checkpoint."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.session import scratch
from quern.streaming import streams, timers

SLICES = 3


def streamed(t, build) -> DataFrame:
    """What a stream over the events has put out once all slices have come; build: stream -> stream."""
    folder, out, checkpoint = (scratch(t.spark, x) for x in ("arriving", "streamed", "stream"))
    events = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    marks = events.agg(F.percentile_approx(F.unix_micros("ts"), [i / SLICES for i in range(1, SLICES)])).first()[0] or [0] * (SLICES - 1)
    bounds, found = [None, *marks, None], None
    for low, high in zip(bounds, bounds[1:]):
        own = events.where((F.lit(low is None) | (F.unix_micros("ts") >= F.lit(low))) & (F.lit(high is None) | (F.unix_micros("ts") < F.lit(high))))
        own.write.mode("append").parquet(folder)
        found = streams.run_once(build(t.spark.readStream.schema(events.schema).parquet(folder)), out, checkpoint)
    return found


CLOSED = "(SELECT epoch_ms(max(ts)) * 1000 - 3600000000 FROM events)"


@query(f"""WITH w AS (SELECT event_type, epoch_us(ts) - epoch_us(ts) % 7200000000 - k * 7200000000 AS start_us FROM events, unnest(range(3)) r(k))
SELECT start_us, event_type, count(*) AS n FROM w WHERE start_us + 21600000000 <= {CLOSED} GROUP BY ALL""")
def x7_sliding(t):
    """Counts in windows of six hours that begin every two; those closed by the last watermark."""
    return streamed(t, lambda s: streams.sliding(s, "ts", "event_type", "6 hours", "2 hours")).select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query(f"""WITH g AS (SELECT user_id, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 43200000000, true) AS fresh FROM events),
s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(t) AS start_us, max(t) + 43200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k HAVING max(t) + 43200000000 <= {CLOSED}""")
def x7_sessions(t):
    """Each user's events without a pause of twelve hours; sessions closed by the last watermark."""
    return streamed(t, lambda s: streams.sessions(s, "user_id", "ts", "12 hours")).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("WITH r AS (SELECT *, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events) SELECT user_id, mark, min_by(event_id, (ts, event_id)) AS event_id, CAST(min_by(running, (ts, event_id)) AS BIGINT) AS running FROM r, (VALUES (250), (500), (1000), (2000)) m(mark) WHERE mark <= running GROUP BY user_id, mark")
def x3_crossings(t):
    """w10 as a stream with state: each mark when a user's running sum first reaches it."""
    build = lambda s: timers.crossings(s.withColumn("whole", F.floor("value").cast("double")), "user_id", "ts", "event_id", "whole", [250, 500, 1000, 2000])
    return streamed(t, build).select("user_id", F.col("mark").cast("int").alias("mark"), "event_id", F.col("running").cast("long").alias("running"))


@query(f"SELECT user_id, epoch_us(ts) AS at_us FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events) WHERE epoch_us(nxt) - epoch_us(ts) > 86400000000 OR nxt IS NULL AND (epoch_us(ts) // 1000 + 86400001) * 1000 <= {CLOSED}")
def x3_stalls(t):
    """w11 as a stream with timers: silences of over a day, those still open by the last watermark too."""
    return streamed(t, lambda s: timers.stalls(s, "user_id", "ts", 86400.0)).select("user_id", F.unix_micros("at").alias("at_us"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, 1 AS times FROM documents")
def s17_growing_files(t):
    """A line for each document in files that grow twice, the first time up to anywhere in a line; each line is read once."""
    folder, out, checkpoint = (scratch(t.spark, x) for x in ("growing", "lines", "tail"))
    lines = t.documents.select(F.concat_ws(" ", "doc_id", F.md5(F.coalesce("text", F.lit("")))).alias("line"), "doc_id").repartition(8, "doc_id").sortWithinPartitions("doc_id").select("line")
    for share in (0.5, 1.0):
        grown(lines, folder, share)
        found = streams.run_once(streams.growing(t.spark, folder), out, checkpoint)
    parts = F.split("line", " ")
    return found.groupBy(parts[0].cast("long").alias("doc_id"), parts[1].alias("digest")).agg(F.count("*").cast("int").alias("times"))


def grown(lines: DataFrame, folder: str, share: float) -> None:
    """Appends to each partition's file what it lacks of the first `share` of its bytes; doing it again adds nothing."""
    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        path = f"{at}/part-{TaskContext.get().partitionId():05d}.log"
        whole = b"".join(x.encode() + b"\n" for b in batches for x in b.column(0).to_pylist())
        have = max(0, system.get_file_info(path).size or 0)
        with system.open_append_stream(path) as f:
            f.write(whole[have : int(len(whole) * share)])
        yield from ()

    lines.mapInArrow(run, "line string").write.format("noop").mode("overwrite").save()
