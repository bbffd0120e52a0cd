"""Numbers over ranges, re-cuts by content, task tables, picks, rings."""

from pyspark.sql import functions as F

from quern.operators import numbering, recut, rings, tasks
from quern.sources import readers


def test_numbers_run_through_all_ranges(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"), F.lit("x").alias("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbering.numbered(rows, [-F.col("v")], "n")
        assert got.select(F.shiftright(F.monotonically_increasing_id(), 33)).distinct().count() > 1
        assert {(r["v"], r["n"]) for r in got.collect()} == {(v, 1000 - v) for v in range(1000)} and got.columns == ["v", "id", "n"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["n"] for r in numbering.numbered(rows.limit(5), [F.lit(1)], "n", 0).collect()) == [0, 1, 2, 3, 4]
    assert numbering.numbered(rows.limit(0), [F.col("v")]).count() == 0


def words(contents):
    return contents.select("sha", F.posexplode(F.split("text", " ")).alias("idx", "unit"))


def test_only_new_contents_are_cut(spark, tmp_path):
    docs = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    store = f"file://{tmp_path}/store"
    one = docs("a b", "c", "a b", None, "d e f")
    assert recut.recut(one, store, "v1", words) == 4 and recut.recut(one, store, "v1", words) == 0
    two = docs("a b", "c new", "a b", "", "d e f")
    assert recut.recut(two, store, "v1", words) == 1
    got = {(r["doc_id"], r["idx"], r["unit"]) for r in recut.units(two, store, "v1").collect()}
    assert got == {(0, 0, "a"), (0, 1, "b"), (2, 0, "a"), (2, 1, "b"), (1, 0, "c"), (1, 1, "new"), (3, 0, ""), (4, 0, "d"), (4, 1, "e"), (4, 2, "f")}
    assert recut.recut(two, store, "v2", lambda c: c.select("sha", F.lit(0).alias("idx"), F.upper("text").alias("unit"))) == 4  # a new version cuts all anew
    assert {r["unit"] for r in recut.units(two, store, "v2").collect()} == {"A B", "C NEW", "", "D E F"}
    assert {r["unit"] for r in recut.units(one, store, "v1").where("doc_id = 1").collect()} == {"c"}  # what was cut stays
    assert recut.units(two, store, "v3").count() == 0


def test_task_tables(spark, tmp_path):
    path = f"file://{tmp_path}/tasks"
    heads = spark.createDataFrame([("a", "t1"), ("b", "t2")], "task_id string, title string")
    rounds = spark.createDataFrame([("a", "r2", "q2"), ("a", "r1", "q1"), ("z", "r1", "lost")], "task_id string, round_id string, query string")
    checks = spark.createDataFrame([("a", "r1", "c2", "req", False), ("a", "r1", "c1", "req", True), ("a", "r9", "c1", "lost", True)], "task_id string, round_id string, id string, requirement string, passed boolean")
    assert tasks.materialise(tasks.nested(heads, rounds, checks), path, "all") == 2
    got = {r["task_id"]: r["rounds"] for r in tasks.materialised(spark, path, "all").collect()}
    assert [(r["round_id"], [(c["id"], c["passed"]) for c in r["checklist"]]) for r in got["a"]] == [("r1", [("c1", True), ("c2", False)]), ("r2", [])] and got["b"] == []
    before = tasks.materialised(spark, path, "all")
    assert tasks.materialise(tasks.nested(heads.limit(1), rounds.limit(0), checks.limit(0)), path, "all") == 1
    assert tasks.materialised(spark, path, "all", "title string, " + readers.TASKS).select("title").collect()[0]["title"] == "t1"
    assert before.count() == 2  # who reads the old table keeps it


def test_picks_stay_or_are_made(spark):
    shape = "rule int, axis string, pick string, score double"
    needed = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b")], "rule int, axis string")
    got = tasks.with_picks(needed, spark.createDataFrame([(1, "a", None, 0.5), (9, "a", "gone", 1.0)], shape), spark.createDataFrame([(1, "a", "x", 9.0), (2, "a", "z", 1.0), (2, "a", "y", 1.0), (2, "a", "w", 0.5)], shape))
    assert sorted(map(tuple, got.collect())) == [(1, "a", None, 0.5, False), (2, "a", "y", 1.0, True), (3, "b", None, None, True)]


def test_rings_nest(spark, tmp_path):
    paths = spark.createDataFrame([(["a", "x"],)] * 3 + [(["a"],)] + [(["b", "y & z"],)] * 4, "path array<string>")
    nodes = rings.ring(paths)
    got = {"/".join(r["prefix"]): (r["n"], r["a0"], r["a1"]) for r in nodes.collect()}
    assert got == {"a": (4, 0.0, 0.5), "b": (4, 0.5, 1.0), "a/x": (3, 0.0, 0.375), "b/y & z": (4, 0.5, 1.0)}
    rings.report(nodes, f"file://{tmp_path}/ring", "rules")
    lines = [r["value"] for r in spark.read.text(f"file://{tmp_path}/ring").collect()]
    import xml.etree.ElementTree as ET

    root = ET.fromstring("\n".join(lines))
    assert [e.tag.rsplit("}", 1)[1] for e in root] == ["text", "path", "path", "path", "path"] and "b / y & z: 4" in {e[0].text for e in root if len(e)}
    assert rings.ring(paths.limit(0)).count() == 0
