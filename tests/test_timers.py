"""State that ends: keys that have been still go from the state store; windows with late events."""

from pyspark.sql import functions as F

from quern.streaming import streams, timers

SCHEMA = "k string, at timestamp, id long, v double"
BEGAN = 1_704_067_200


def arriving(spark, folder, rows):
    spark.createDataFrame(rows, "k string, s long, id long, v double").select("k", F.timestamp_seconds(F.col("s") + BEGAN).alias("at"), "id", "v").coalesce(1).write.mode("append").json(folder)


def state_rows(spark, checkpoint):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "state").load().count()


def test_state_of_ended_keys_goes(spark, tmp_path):
    folder, checkpoint = f"{tmp_path}/in", f"{tmp_path}/c"
    run = lambda: streams.run_once(timers.crossings(streams.tail(spark, folder, SCHEMA), "k", "at", "id", "v", [10.0, 20.0], idle=3600.0, late="1 minute"), f"{tmp_path}/out", checkpoint)
    arriving(spark, folder, [(f"k{i}", 0, i, 6.0) for i in range(30)] + [("x", 0, 50, 6.0), ("x", 100, 51, 6.0)])
    assert sorted(map(tuple, run().collect())) == [("x", 10.0, 51, 12.0)] and state_rows(spark, checkpoint) == 31
    arriving(spark, folder, [("x", 9000, 60, 9.0), ("y", 9000, 61, 25.0)])  # the others have been still for over an hour
    got = sorted(map(tuple, run().collect()))
    assert state_rows(spark, checkpoint) == 2
    assert got == [("x", 10.0, 51, 12.0), ("x", 20.0, 60, 21.0), ("y", 10.0, 61, 25.0), ("y", 20.0, 61, 25.0)]
    arriving(spark, folder, [("k3", 9100, 70, 9.0)])  # begins anew: 6 + 9 would cross
    assert len(run().collect()) == len(got)


def test_order_within_a_batch_is_by_time(spark, tmp_path):
    folder = f"{tmp_path}/in"
    arriving(spark, folder, [("a", 30, 3, 1.0), ("a", 10, 1, 4.0), ("a", 20, 2, None), ("a", 20, 5, 6.0)])
    got = streams.run_once(timers.crossings(streams.tail(spark, folder, SCHEMA), "k", "at", "id", "v", [10.0, 4.0]), f"{tmp_path}/out", f"{tmp_path}/c").collect()
    assert sorted(map(tuple, got)) == [("a", 4.0, 1, 4.0), ("a", 10.0, 5, 10.0)]


def test_silence_told_once_and_again_after_a_new_event(spark, tmp_path):
    folder, checkpoint = f"{tmp_path}/in", f"{tmp_path}/c"
    run = lambda: sorted((r["k"], int(r["at"].timestamp()) - BEGAN, r["gap_s"]) for r in streams.run_once(timers.stalls(streams.tail(spark, folder, SCHEMA), "k", "at", 100.0, "1 second", idle=500.0), f"{tmp_path}/out", checkpoint).collect())
    arriving(spark, folder, [("a", 0, 1, 1.0), ("b", 0, 2, 1.0), ("b", 150, 3, 1.0)])
    assert run() == [("a", 0, None), ("b", 0, 150.0)]
    arriving(spark, folder, [("a", 300, 4, 1.0), ("b", 200, 5, 1.0)])
    first = [("a", 0, None), ("b", 0, 150.0)]
    assert run() == first
    arriving(spark, folder, [("c", 2000, 6, 1.0)])
    assert run() == sorted([*first, ("a", 300, None), ("b", 200, None)], key=lambda r: r[:2])
    arriving(spark, folder, [("c", 2001, 7, 1.0)])
    run()
    assert state_rows(spark, checkpoint) == 1


def test_keys_share_groups_of_state(spark, tmp_path):
    folder, checkpoint = f"{tmp_path}/in", f"{tmp_path}/c"

    def run(rows):
        spark.createDataFrame(rows, "k long, s long").select("k", F.timestamp_seconds(F.col("s") + BEGAN).alias("at")).coalesce(1).write.mode("append").parquet(folder)
        found = streams.run_once(timers.stalls(spark.readStream.schema("k long, at timestamp").parquet(folder), "k", "at", 100.0), f"{tmp_path}/out", checkpoint)
        return {(r["k"], int(r["at"].timestamp()) - BEGAN, r["gap_s"]) for r in found.collect()}

    keys = {None if i == 7 else 2**53 + i: 50 + 100 * (i % 3) for i in range(1100)}  # null, and such as no double tells apart
    told = {(k, 0, float(s)) for k, s in keys.items() if s > 100}
    assert run([(k, x) for k, s in keys.items() for x in (0, s)]) == told
    assert spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "state").load().select("key").distinct().count() <= 1024
    assert state_rows(spark, checkpoint) == 1100
    assert run([(1, 9000)]) == told | {(k, s, None) for k, s in keys.items()}


def test_late_event_joins_two_sessions(spark, tmp_path):
    folder = f"{tmp_path}/in"
    run = lambda: sorted((r["k"], int(r["start"].timestamp()) - BEGAN, int(r["end"].timestamp()) - BEGAN, r["n"]) for r in streams.run_once(streams.sessions(streams.tail(spark, folder, SCHEMA), "k", "at", "10 minutes", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/c").collect())
    arriving(spark, folder, [("a", 0, 1, 1.0), ("a", 900, 2, 1.0)])
    assert run() == []
    arriving(spark, folder, [("a", 450, 3, 1.0), ("b", 9000, 4, 1.0)])  # late, but not later than the watermark
    assert run() == [("a", 0, 1500, 3)]
    arriving(spark, folder, [("a", 1400, 5, 1.0)])  # too late: its session has been told
    assert run() == [("a", 0, 1500, 3)]


def test_sliding_windows_count_late_events(spark, tmp_path):
    folder = f"{tmp_path}/in"
    run = lambda: sorted((int(r["start"].timestamp()) - BEGAN, r["k"], r["n"]) for r in streams.run_once(streams.sliding(streams.tail(spark, folder, SCHEMA), "at", "k", "20 minutes", "10 minutes", "30 minutes"), f"{tmp_path}/out", f"{tmp_path}/c").collect())
    arriving(spark, folder, [("a", 1300, 1, 1.0)])
    assert run() == []
    arriving(spark, folder, [("a", 1250, 2, 1.0), ("b", 5400, 3, 1.0)])
    assert run() == [(600, "a", 2), (1200, "a", 2)]
