"""Ordered append logs: the last append wins, whatever files are called; snapshots, late commits, failed and concurrent writers."""

import os
import shutil
from concurrent.futures import ThreadPoolExecutor

from quern.sources import logs, readers, writers

SCHEMA = "k string, v int, error string"


def put(spark, path, *rows):
    return writers.append_checkpoint(spark.createDataFrame(list(rows), SCHEMA), path)


def last(spark, path):
    return {r["k"]: r["v"] for r in readers.checkpoint(spark, path, SCHEMA, "k").collect()}


def test_the_last_of_many_appends_wins(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for i in range(100):
        assert put(spark, path, ("a", i, None)) == i + 1
        if i % 25 == 24:
            assert last(spark, path) == {"a": i}


def test_order_within_an_append_and_errors(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([("a", i, None) for i in range(50)] + [("b", 1, None), ("b", 2, "failed"), (None, 3, None)], SCHEMA)
    writers.append_checkpoint(rows.repartition(1).repartition(7).orderBy("k", "v"), path)
    assert last(spark, path) == {"a": 49, "b": 1}
    put(spark, path, ("a", -1, "failed"), ("b", 7, None))
    assert last(spark, path) == {"a": 49, "b": 7}


def test_torn_lines_and_failed_appends_are_not_seen(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    put(spark, path, ("a", 1, None))
    n = put(spark, path, ("a", 2, None))
    os.remove(f"{tmp_path}/log/commit={n:012d}/_SUCCESS")  # as a job leaves it that dies while it commits
    assert last(spark, path) == {"a": 1}
    m = put(spark, path, ("a", 3, None))
    with open(f"{tmp_path}/log/commit={m:012d}/part-99999-torn.json", "w") as f:
        f.write('{"k": "a", "v": 9')
    assert m == n + 1 and last(spark, path) == {"a": 3}


def test_snapshots_and_a_commit_that_ends_late(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    put(spark, path, ("a", 1, None), ("b", 1, None))
    late = put(spark, path, ("a", 2, None), ("c", 2, None))
    put(spark, path, ("b", 3, None), ("c", 3, None))
    mark = f"{tmp_path}/log/commit={late:012d}/_SUCCESS"
    os.remove(mark)
    logs.snapshot(spark, path, "k")
    assert last(spark, path) == {"a": 1, "b": 3, "c": 3}
    open(mark, "w").close()  # it began before the snapshot: later than a's first record, before c's last
    assert last(spark, path) == {"a": 2, "b": 3, "c": 3}
    put(spark, path, ("b", 5, None))
    logs.snapshot(spark, path, "k")
    assert logs.vacuum(spark, path) == 5 and last(spark, path) == {"a": 2, "b": 5, "c": 3}
    assert put(spark, path, ("a", 6, None)) == 7 and last(spark, path)["a"] == 6


def test_writers_at_once_get_different_numbers(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    with ThreadPoolExecutor(4) as pool:
        claims = list(pool.map(lambda i: logs.claimed(spark, f"{path}-only"), range(200)))
        assert sorted(claims) == list(range(1, 201))
        numbers = list(pool.map(lambda i: put(spark, path, (f"k{i}", i, None)), range(12)))
    assert sorted(numbers) == list(range(1, 13)) and last(spark, path) == {f"k{i}": i for i in range(12)}


def test_files_of_others_are_ordered_by_time(spark, tmp_path):
    folder = tmp_path / "plain"
    folder.mkdir()
    for i, name in enumerate(("z", "m", "a")):
        (folder / f"{name}.jsonl").write_text(f'{{"k": "a", "v": {i}}}\n')
        os.utime(folder / f"{name}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))
    assert last(spark, f"file://{folder}") == {"a": 2}
    shutil.copy(folder / "z.jsonl", folder / "b.jsonl")  # copied now, so the latest
    assert last(spark, f"file://{folder}") == {"a": 0}


def test_empty_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    writers.append_checkpoint(spark.createDataFrame([], SCHEMA), path)
    assert last(spark, path) == {} and logs.snapshot(spark, path, "k") == 2 and last(spark, path) == {}
