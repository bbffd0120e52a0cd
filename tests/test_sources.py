"""Readers, writers and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import filters, merge
from quern.sources import readers, writers
from quern.streaming import streams, timers


def test_configuration_files(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps([{"clause_id": "a", "text": "x\ny"}, {"clause_id": "b"}], indent=1))
    rules = readers.read_rules(spark, str(tmp_path / "rules.json"), "clause_id string, text string").collect()
    assert [tuple(r) for r in rules] == [("a", "x\ny"), ("b", None)]
    (tmp_path / "aliases.json").write_text(json.dumps([["^py.*", "Python"], ["js$", "JavaScript"]]))
    assert [tuple(a) for a in readers.aliases(spark, str(tmp_path / "aliases.json"))] == [("^py.*", "Python"), ("js$", "JavaScript")]


def test_tasks(spark, tmp_path):
    task = {"task_id": "t1", "rounds": [{"round_id": "1", "query": "do it", "checklist": [{"id": "c", "requirement": "r", "passed": None}]}, {"round_id": "2", "checklist": []}]}
    (tmp_path / "tasks.jsonl").write_text(json.dumps(task) + '\n\n{"task_id": "t2", "rou\n')
    rows = readers.tasks(spark, str(tmp_path / "tasks.jsonl")).collect()
    assert [r["task_id"] for r in rows] == ["t1"] and rows[0]["rounds"][0]["checklist"][0]["requirement"] == "r" and rows[0]["rounds"][1]["query"] is None


def test_checkpoint_round_trip(spark, tmp_path):
    path, schema = f"file://{tmp_path}/done", "k string, v int, error string"
    for rows in ([("a", 1, None), ("b", 1, "timeout")], [("b", 2, None)]):
        writers.append_checkpoint(spark.createDataFrame(rows, schema), path)
    assert sorted((r["k"], r["v"]) for r in readers.checkpoint(spark, path, schema, "k").collect()) == [("a", 1), ("b", 2)]


def test_tables_and_exports(spark, tmp_path):
    for _ in range(2):
        writers.create_table(spark, "made_once", "id int, text string")
    assert spark.table("made_once").columns == ["id", "text"] and spark.table("made_once").count() == 0
    spark.sql("DROP TABLE made_once")
    df = spark.createDataFrame([(2, "ü"), (1, None)], "id int, text string")
    writers.export_json(df, str(tmp_path / "out.json"), ["id"])
    assert json.loads((tmp_path / "out.json").read_text(encoding="utf-8")) == [{"id": 1, "text": None}, {"id": 2, "text": "ü"}]
    writers.export_json(df.limit(0), str(tmp_path / "none.json"), ["id"])
    assert json.loads((tmp_path / "none.json").read_text()) == []
    writers.write_run(df, f"file://{tmp_path}/run", {"cost": 1.5}, classes=df.select("id"))
    assert spark.read.json(f"file://{tmp_path}/run/result").count() == 2 == spark.read.json(f"file://{tmp_path}/run/classes").count()
    assert json.loads(spark.read.text(f"file://{tmp_path}/run/run").first()[0]) == {"cost": 1.5}


def test_conforming(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    df = spark.createDataFrame([("x", 1)], "text string, id int")
    assert filters.conforming(df, schema).schema.simpleString() == "struct<id:bigint,text:string>"
    with pytest.raises(ValueError, match=r"missing columns: \['text'\]; extra columns: \['more'\]"):
        filters.conforming(df.withColumnRenamed("text", "more"), schema)


def test_one_per_content(spark):
    files = spark.createDataFrame([(3, "s", "c"), (1, "s", "a"), (2, "t", "b")], "id int, sha string, path string")
    assert sorted(tuple(r) for r in merge.one_per_content(files, "sha", "id").collect()) == [("s", 1, "a", 2), ("t", 2, "b", 1)]


SCHEMA = "k string, at timestamp, kind string"


BEGAN = 1_000_000 * 900


def arriving(spark, folder, rows):
    spark.createDataFrame([(k, s, kind) for k, s, kind in rows], "k string, s long, kind string").select("k", F.timestamp_seconds(F.col("s") + BEGAN).alias("at"), "kind").write.mode("append").json(folder)


def test_stalls_show_without_a_next_event(spark, tmp_path):
    folder = f"{tmp_path}/in"
    arriving(spark, folder, [("a", 0, "x"), ("a", 10, "x"), ("a", 5000, "x"), ("b", 0, "x")])
    found = lambda: sorted((r["k"], r["at"].timestamp() - BEGAN, r["gap_s"]) for r in streams.run_once(timers.stalls(streams.tail(spark, folder, SCHEMA), "k", "at", 1200, "1 minute"), f"{tmp_path}/out", f"{tmp_path}/c").collect())
    first = [("a", 10.0, 4990.0), ("b", 0.0, None)]
    assert found() == first
    arriving(spark, folder, [("b", 5100, "x"), ("c", 9000, "x")])
    assert found() == sorted([*first, ("a", 5000.0, None), ("b", 5100.0, None)])  # b's first silence is not told again


def test_status_windows_and_merged_batches(spark, tmp_path):
    folder = f"{tmp_path}/in"
    arriving(spark, folder, [("a", 0, "x"), ("a", 60, "x"), ("a", 899, "y"), ("a", 900, "x"), ("a", 90000, "x")])
    status = streams.run_once(streams.status(streams.tail(spark, folder, SCHEMA), "at", "kind"), f"{tmp_path}/out", f"{tmp_path}/c")
    assert sorted((r["start"].timestamp() - BEGAN, r["kind"], r["n"]) for r in status.collect()) == [(0.0, "x", 2), (0.0, "y", 1), (900.0, "x", 1)]
    target = f"file://{tmp_path}/table"
    for _ in range(2):  # what was merged is not merged again
        streams.merge_batches(streams.tail(spark, folder, SCHEMA), lambda df, i: df.write.mode("append").parquet(target), f"{tmp_path}/cm")
    assert spark.read.parquet(target).count() == 5
