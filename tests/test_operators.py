"""Operators on hand fixtures: votes, rails, partitions, merges, hooks, readers, writers, streams, semantic stages."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import code, text
from quern.operators import checks, evaluation, filters, merge, metrics, python_backed, segments, semantic, sessions, trees, votes
from quern.plans.registry import Tables
from quern.sources import readers, writers
from quern.streaming import streams, timers


def attempts(spark, rows):
    return spark.createDataFrame(rows, "rule string, axis string, rep int, values array<string>")


def test_vote_plan(spark):
    rows = [("a", "e", 1, ["ESLint"]), ("a", "e", 2, []), ("a", "e", 3, [])]
    rows += [("b", "e", 1, ["Unit-Tests", "`x`"]), ("b", "e", 2, ["X", "unit tests"]), ("b", "e", 3, ["unit tests", "x"])]
    rows += [("c", "e", 1, ["one"]), ("c", "e", 2, ["two"]), ("c", "e", 3, [])]
    got = {r["rule"]: (r["named"], r["how"], r["values"]) for r in votes.vote_plan(attempts(spark, rows)).collect()}
    assert got["a"] == (1, "null", [])
    assert got["b"][1] == "pattern" and got["b"][2] == ["unit tests", "`x`"]
    assert got["c"][1:] == ("ask", [])


def test_rails(spark):
    a = attempts(spark, [("r", "e", 1, ["a <b>"]), ("r", "e", 2, ["a <b>"]), ("r", "e", 3, [])])
    answers = spark.createDataFrame([("r", "e", 0, "a <b>", [1, 2]), ("r", "e", 1, "a <b>", [1, 1]), ("r", "e", 2, "a &lt;b&gt;", [2, 1]), ("r", "e", 3, "new", [1, 2]), ("r", "e", 4, "a <b>", [1, 3])], "rule string, axis string, pos int, value string, cited array<int>")
    assert sorted((r["pos"], r["value"]) for r in votes.railed(answers, a).collect()) == [(0, "a <b>"), (2, "a <b>")]


def test_first_alias_wins(spark):
    df = spark.createDataFrame([(" Pytest run ",), ("other",), (None,)], "v string").select(votes.aliased(F.col("v"), [("test", "tests"), ("pytest", "never")]).alias("n"))
    assert [r["n"] for r in df.collect()] == ["tests", "other", None]


def test_partition_is_repaired_or_refused():
    asked = []

    def place(ids, names):
        asked.append(ids)
        return {i: "new" if i == 5 else names[0] for i in ids}

    assert votes.repaired({"x": [1, 2, 9], "y": [2, 3], "z": []}, {1, 2, 3, 4, 5}, place) == {"x": [1, 2, 4], "y": [3], "new": [5]}
    assert asked == [[2, 4, 5]]
    with pytest.raises(ValueError):
        votes.repaired({"x": [1]}, {1, 2}, lambda ids, names: {})


def test_validation(spark):
    df = spark.createDataFrame([("1", "t", True, "k"), ("2", " ", True, "k")], "clause_id string, rule_text string, is_rule boolean, other string")
    good = filters.validated(df.where("clause_id = '1'"), "clause_id", ["rule_text"], ["clause_id", "rule_text"])
    assert good.columns == ["clause_id", "rule_text"]
    with pytest.raises(ValueError, match="blank rule_text"):
        filters.validated(df, "clause_id", ["rule_text"], ["clause_id"])
    with pytest.raises(ValueError, match="repeated"):
        filters.validated(df.where("clause_id = '1'").unionAll(df.where("clause_id = '1'")), "clause_id", ["rule_text"], ["clause_id"])


def test_merge_modes_and_swap(spark, tmp_path):
    path, schema = f"file://{tmp_path}/table", "id int, f string"
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema)
    assert writers.insert(first, path, "id", "f", order=["id"]) == {"kept": 0, "replaced": 0, "added": 3, "total": 3}
    new = spark.createDataFrame([(3, "b"), (4, "b"), (5, "c")], schema)
    assert writers.insert(new, path, "id", "f", "append", dry_run=True)["added"] == 2
    assert writers.insert(new, path, "id", "f", "sync", order=["id"]) == {"kept": 2, "replaced": 1, "added": 3, "total": 5}
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")]
    assert writers.insert_one(spark, {"id": 1, "f": "z"}, schema, path, "id", "f")["added"] == 0
    with pytest.raises(ValueError):
        merge.merged(first, new, "id", "f", "other")


def test_staged_load_is_idempotent(spark, tmp_path):
    path, staged = f"file://{tmp_path}/t", f"file://{tmp_path}/s"
    for _ in range(2):
        spark.createDataFrame([(1,), (2,)], "id int").write.parquet(staged)
        writers.load_staged(spark, [staged], path, "id")
    assert spark.read.parquet(path).count() == 2


def test_checkpoint_reading(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "a", "v": 1}\n{"id": "b", "v": 2, "error": "x"}\n{"id": "a", "v": 3}\n{"id": "a", "v"\n\n{"id": "c", "v": 4}\n{"id": "a", "v": 9, "error": "late"}\n')
    got = readers.checkpoint(spark, f"file://{tmp_path}/c.jsonl", "id string, v int, error string", "id")
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [("a", 3), ("c", 4)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "l1.jsonl").write_text('{"cost": 1.5}\nnot json\n')
    (tmp_path / "l2.jsonl").write_text('{"cost": 2.0}\n')
    assert readers.json_lines(spark, f"file://{tmp_path}/l*.jsonl", "cost double").agg(F.sum("cost")).first()[0] == 3.5
    with pytest.raises(Exception):
        readers.json_lines(spark, f"file://{tmp_path}/l1.jsonl", "cost double", "fail").collect()


def test_shards(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    schema = spark.createDataFrame([], "id int, v string").schema
    assert readers.read_shards(spark, path, schema).count() == 0
    writers.write_shards(spark.range(1000).select(F.col("id").cast("int"), F.lit("x").alias("v")), path, ["id"], rows=300)
    assert readers.read_shards(spark, path, schema, ["id"]).count() == 1000


def test_mapped_columns_and_probe(spark):
    df = spark.createDataFrame([(2, "b", 1), (1, "a", 1)], "k int, body string, extra int")
    out = readers.mapped_columns(df, {"id": "k", "text": "body", "stars": None, "link": None}, "k > 0", {"stars": 0}, ["id"])
    assert [tuple(r) for r in out.collect()] == [(1, "a", 0, None), (2, "b", 0, None)]
    assert readers.probe(df, {"id": "k", "text": "gone"}) == {"columns": ["k", "body", "extra"], "rows": 2, "unmapped": ["body", "extra"], "lacking": ["gone"]}
    with pytest.raises(ValueError):
        readers.rules_table(spark, "rules; drop")


def test_project_files_and_nodes(spark, tmp_path):
    for name, body in (("n/a.md", "# Lint\nkind: enforcer\n- uses: see [b](b.md) and [c](x/c.md)\n"), ("n/b.md", "# Hook\nkind: trigger\n"), ("n/.git/x.md", "no"), ("n/z.bin", "a\x00b")):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(body)
    files = readers.project_files(spark, f"file://{tmp_path}/n")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.collect()) == ["a.md", "b.md"]
    nodes, edges = readers.markdown_nodes(files)
    assert sorted(tuple(r) for r in nodes.collect()) == [("a", "enforcer", "Lint"), ("b", "trigger", "Hook")]
    assert sorted(tuple(r) for r in edges.collect()) == [("a", "b", "uses"), ("a", "c", "uses")]


def test_trees(spark):
    nodes = readers.tree_nodes(spark, {"root": {"a": ["x", "y"], "b": []}}, {"x": "an x"})
    assert {r["node"]: (r["parent"], r["is_leaf"], r["description"]) for r in nodes.collect()}["root/a/x"] == ("root/a", True, "an x")
    p = spark.createDataFrame([("i", "root/a", 0.6), ("i", "root/b", 0.4), ("i", "root/a/x", 0.5), ("i", "root/a/y", 0.5)], "item string, node string, p double")
    got = [(r["rank"], r["path"]) for r in trees.beam(nodes, p, 2, 4).orderBy("rank").collect()]
    assert got == [(1, ["a", "x"]), (2, ["a", "y"])]


def test_settings(spark):
    rows = [(0, "user", json.dumps({"hooks": {"Pre": [{"matcher": "A", "command": "x"}, {"matcher": "B"}]}})), (1, "project", "{broken"), (2, "local", json.dumps({"hooks": {"Post": [{"command": "y"}]}}))]
    good, bad = readers.settings(spark.createDataFrame(rows, "ord int, path string, content string"))
    assert sorted((r["ord"], r["event"], r["command"]) for r in good.collect()) == [(0, "Pre", "x"), (2, "Post", "y")]
    assert sorted((r["path"], r["fault"]) for r in bad.collect()) == [("project", "not readable"), ("user", "no command in Pre")]


def test_permission_over_time(spark):
    rows = [(1, 0, "ok"), (1, 60, "ask"), (1, 3600, "ask"), (2, 0, "ok"), (2, 10, "fail"), (2, 20, "ask"), (3, 5, "ask")]
    df = spark.createDataFrame(rows, "k int, s int, what string").select("k", "what", F.timestamp_seconds("s").alias("t"), "s")
    w = F.col("what")
    assert {(r["k"], r["s"]): r["allowed"] for r in sessions.permitted(df, "k", "t", "s", w == "ask", w == "ok", w == "fail").collect()} == {(1, 60): True, (1, 3600): False, (2, 20): False, (3, 5): False}


def test_three_valued_tables(spark):
    v = spark.createDataFrame([("R1", "A", True), ("R1", "A", None), ("R1", "B", False), ("R2", "A", None)], "rule string, arm string, passed boolean")
    got = {(r["rule"], r["arm"]): (r["passed"], r["scored"], r["pct"]) for r in metrics.pass_table(v).collect()}
    assert got[("R1", "A")] == (1, 1, 100.0) and got[("R2", "A")] == (0, 0, 0.0) and got[(None, "A")] == (1, 1, 100.0)


def test_checks(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(checks.starts_with(F.lit("  [OK] x"), "[OK]")) and not one(checks.ends_with(F.lit("done x"), "done"))
    assert one(checks.avoids(F.lit("we use `you` and you-know only"), ("you",), ("you-know",))) and not one(checks.avoids(F.lit("thank you"), ("you",)))
    assert one(checks.in_chinese(F.lit("你好 API"))) and not one(checks.in_chinese(F.lit("你好 and then")))
    assert one(text.norm(F.lit(" `Unit_Tests` (all) "))) == "unit tests"


def test_code_checks():
    assert code.function_lengths("a.py", "def f():\n    pass\n\nclass A:\n    def g(self):\n        x = 1\n        return x\n") == [("f", 1, 2), ("g", 5, 3)]
    assert code.function_lengths("a.js", "function f(a) {\n  return '{';\n}\nconst g = (x) => {\n return 1 }\n") == [("f", 1, 3), ("g", 4, 2)]
    assert code.function_lengths("a.sh", "go() {\n  x\n}\n") == [("go", 1, 3)]
    assert code.function_lengths("a.html", "<p>\n<script>\nfunction f() {\n}\n</script>") == [("f", 3, 2)]
    assert code.function_lengths("a.py", "def (") == []
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "integer"}}}, "additionalProperties": False}
    assert code.schema_errors({"a": [1, "x"], "b": 1}, schema) == ["$.b is not known", "$.a[1] is not integer"]
    with pytest.raises(ValueError):
        code.strict_schema({"type": "object", "properties": {"a": {"type": "string"}}})


def test_faults_are_located():
    bad = lambda lines: any("x" in line for line in lines)
    found, checks = code.located(["a", "x", "b", "x"], bad)
    assert sorted(found) == [([2], "line"), ([4], "line")] and checks < 16
    joint = lambda lines: "begin" in lines and "end" in lines
    assert code.located(["a", "begin", "b", "end", "c"], joint)[0] == [([2, 4], "joint")]
    assert code.located(["a"] * 5, lambda lines: len(lines) > 4)[0] == [([1, 2, 3, 4, 5], "line count")]
    assert code.located([], bad) == ([], 0) and code.located(["a"], bad) == ([], 1)
    assert code.least_files(["a", "b", "c"], lambda fs: "a" in fs and "c" in fs) == ["a", "c"]
    assert code.seeded_order("k", 5) == code.seeded_order("k", 5) and sorted(code.seeded_order("k", 5)) == [0, 1, 2, 3, 4]


def test_semantic_stage_resumes_and_reconciles(spark, tmp_path):
    items = spark.createDataFrame([(i, f"text {i}") for i in range(23)], "id int, text string").coalesce(1)
    path = f"file://{tmp_path}/answers"
    got = semantic.sem_map(items, "id", "text", lambda: semantic.Stub(skips=3), path)
    assert got.count() == 23 and got.select("id").distinct().count() == 23

    def refuse():
        raise AssertionError("asked again")

    assert semantic.sem_map(items, "id", "text", refuse, path).count() == 23
    judged = semantic.sem_filter(items, "id", "text", lambda: semantic.Stub(skips=5))
    assert judged.where("is_rule IS NULL").count() == 4 and judged.count() == 23


def test_semantic_filter_asks_once(spark, tmp_path):
    log = f"{tmp_path}/asked"

    class Counting(semantic.Stub):
        def answer(self, batch):
            with open(log, "a") as f:
                f.write("".join(f"{k}\n" for k, _ in batch))
            return super().answer(batch)

    items = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "id int, text string").repartition(3)
    assert semantic.sem_filter(items, "id", "text", Counting).where("is_rule IS NOT NULL").count() == 50
    assert sorted(map(int, open(log))) == list(range(50))


def test_budget_and_retries(monkeypatch):
    b = semantic.Budget(1.0)
    b.record(1.5)
    with pytest.raises(semantic.BudgetSpent):
        b.check()
    b = semantic.Budget(1.0)
    b.record(None)
    with pytest.raises(semantic.BudgetSpent):
        b.check()
    monkeypatch.setattr(semantic.time, "sleep", lambda s: None)
    calls = []

    class Flaky:
        def answer(self, items):
            calls.append(1)
            if len(calls) < 3:
                raise OSError
            return items

    assert semantic.Retrying(Flaky()).answer([("a", "b")]) == [("a", "b")] and len(calls) == 3


def test_streams_equal_batches(spark, tmp_path):
    events = Tables(spark, "/root/testdata/sf0.001").events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    source = f"{tmp_path}/in"
    events.repartition(3).write.json(source)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    stream = streams.tail(spark, source, schema)
    first = streams.run_once(streams.first_alerts(stream, ["user_id", "event_type"], "ts", "60 days"), f"{tmp_path}/a", f"{tmp_path}/ca")
    assert first.count() == events.select("user_id", "event_type").distinct().count()
    whole = events.groupBy("user_id").agg(F.sum("value").alias("total")).where("total >= 100").count()
    crossed = streams.run_once(timers.crossings(stream, "user_id", "ts", "event_id", "value", [100.0]), f"{tmp_path}/b", f"{tmp_path}/cb")
    assert crossed.count() == whole
    again = streams.run_once(timers.crossings(stream, "user_id", "ts", "event_id", "value", [100.0]), f"{tmp_path}/b", f"{tmp_path}/cb")
    assert again.count() == whole


def test_small_text_functions(spark, tmp_path):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    shell = "cat > a.py <<'EOF'\nx\nEOF\ncat <<END > no\ntee b.txt <<END\ny\nEND\n"
    assert one(text.heredoc_targets(F.lit(shell))) == ["a.py", "b.txt"]
    book = json.dumps({"cells": [{"cell_type": "code", "source": ["a = 1\n", "b = 2"]}, {"cell_type": "markdown", "source": ["no"]}, {"cell_type": "code", "source": ["c"]}]})
    assert one(text.notebook_source(F.lit(book))) == "a = 1\nb = 2\n\nc"
    assert one(text.sector(F.lit(0.0), F.lit(0.25), F.lit(1.0), F.lit(2.0))) == "M 0.00 -2.00 A 2.00 2.00 0 0 1 2.00 -0.00 L 1.00 -0.00 A 1.00 1.00 0 0 0 0.00 -1.00 Z"
    assert code.snippet("one two three\nnext", 4, 7) == "one two three"
    long = "word " * 100 + "MARK " + "tail " * 100
    got = code.snippet(long, 500, 504)
    assert "MARK" in got and len(got) <= 160 and set(got.split()) <= {"word", "MARK", "tail"}
    assert code.first_message('x=1\necho "Stop: no" >&2\n') == "Stop: no" and code.first_message("") == ""
    assert code.batch_schema({"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}, "id")["properties"]["results"]["items"]["required"] == ["id", "a"]
    (tmp_path / ".env").write_text("A=1\nexport B='2'\n# no\n")
    assert code.load_env([str(tmp_path)], {"A": "kept"}) == {"A": "kept", "B": "2"}


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"timestamp": "2", "type": "user", "message": {"x": 1}}\nbroken\n{"timestamp": "1", "type": "assistant"}\n')
    got = readers.transcript(spark, f"file://{tmp_path}/a.jsonl").orderBy("timestamp").collect()
    assert [(r["timestamp"], r["type"]) for r in got] == [("1", "assistant"), ("2", "user")]


def test_table_functions(spark):
    from quern.operators import udtfs

    def broken(text, where):
        raise KeyError(where)

    udtfs.register(spark, {"no you": udtfs.forbidden(r"\byou\b(?!-know)", "second person"), "says why": udtfs.required("because", "gives no reason"), "bad": broken})
    spark.createDataFrame([("a", "you-know\nthank you"), ("b", None)], "path string, text string").createOrReplaceTempView("texts")
    got = sorted((r["path"], r["rule"], r["line"]) for r in spark.sql("SELECT path, f.* FROM texts, LATERAL faults(text, path) f").collect())
    assert got == [("a", "bad", -1), ("a", "no you", 2), ("a", "says why", 0), ("b", "bad", -1), ("b", "says why", 0)]
    udtfs.register_segments(spark)
    spark.createDataFrame([("x", "# Head\n\nOne here. Two there.")], "path string, text string").createOrReplaceTempView("docs")
    assert [r["type"] for r in spark.sql("SELECT s.* FROM docs, LATERAL segments(text) s ORDER BY idx").collect()] == ["heading", "clause", "clause"]


def test_ledger_and_staged_loads(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    for cost in (0.5, None):
        writers.append_ledger(spark.createDataFrame([("judge", "m", cost)], "source string, model string, cost double"), path)
    rows = spark.read.json(path).collect()
    assert sorted(r["cost"] or 0 for r in rows) == [0, 0.5] and all(r["ts"].endswith("Z") and r["input_tokens"] is None for r in rows)
    table, staged = f"file://{tmp_path}/table", f"file://{tmp_path}/staged"
    for ids, new in (([1, 1, 2], 2), ([2, 3], 1)):
        spark.createDataFrame([(i,) for i in ids], "id int").write.parquet(staged)
        assert writers.load_staged(spark, [staged], table, "id") == new
    assert sorted(r["id"] for r in spark.read.parquet(table).collect()) == [1, 2, 3]


def test_standalone_clauses(spark):
    rows = spark.createDataFrame([(1, "Do the first thing now; then do the second thing."), (2, None)], "id int, text string")
    assert sorted(tuple(r) for r in python_backed.standalone(rows, "id").collect()) == [(1, ["clause"], 2), (2, [], 0)]


def test_listed_counts_the_rest(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1), (None, 7)], "k string, i int")
    got = {(r["k"], r["i"]): r["n_more"] for r in evaluation.listed(rows, "k", "i", 2).collect()}
    assert got == {("a", 0): 3, ("a", 1): 3, ("b", 1): 0, (None, 7): 0}


def test_duplicate_counts_of_white_space_variants(spark):
    pieces = spark.createDataFrame([(1, 1, "a  b"), (2, 1, "a b"), (2, 2, "c")], "doc_id int, idx int, text string")
    got = segments.duplicate_counts(pieces).collect()
    assert {(r["doc_id"], r["idx"]): r["n_dup_text"] for r in got} == {(1, 1): 2, (2, 1): 2, (2, 2): 1}
    assert len({r["text_sha256"] for r in got}) == 2 and all(len(r["text_sha256"]) == 64 for r in got)


def test_rate_limits_budgets_and_fatal_stops(monkeypatch):
    slept = []
    monkeypatch.setattr(semantic.time, "sleep", slept.append)

    class Raises:
        def __init__(self, *errors):
            self.errors = list(errors)

        def answer(self, items):
            if self.errors:
                raise self.errors.pop(0)
            return items

    one = [("a", "b")]
    limited = Raises(semantic.RateLimited(wait=3), semantic.RateLimited(), semantic.RateLimited(wait=900), OSError())
    assert semantic.Retrying(limited, attempts=2).answer(one) == one and slept == [3, 20.0, 300.0, 10.0]
    with pytest.raises(semantic.RateLimited):
        semantic.Retrying(Raises(*[semantic.RateLimited(wait=0)] * 9)).answer(one)
    stopped = Raises(semantic.Fatal("no quota"), OSError())
    with pytest.raises(semantic.Fatal):
        semantic.Retrying(stopped).answer(one)
    assert len(stopped.errors) == 1
    with pytest.raises(semantic.BudgetSpent):
        semantic.Retrying(Raises(), budget=semantic.Budget(1.0, 1.0)).answer(one)
    with pytest.raises(semantic.Fatal):
        semantic.route("nobody")
    with pytest.raises(semantic.Fatal):
        semantic.route("stub", {}, ["SOME_KEY"])
    assert isinstance(semantic.route("stub", {"SOME_KEY": "x"}, ["SOME_KEY"])(), semantic.Stub)


def test_strict_answers():
    schema = {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}
    assert semantic.Strict(semantic.Stub(lambda t: '{"n": 1}'), schema).answer([("a", "")]) == [("a", '{"n": 1}')]
    for answer in ('{"n": "x"}', '{"n": 1, "m": 2}', "no JSON"):
        with pytest.raises(ValueError):
            semantic.Strict(semantic.Stub(lambda t, a=answer: a), schema).answer([("a", "")])


def test_attribute_question(spark, tmp_path):
    items = spark.createDataFrame([(1, "0.123456"), (2, "2"), (3, "maybe")], "id int, text string")
    got = semantic.sem_attribute(items, "id", "text", lambda: semantic.Stub(lambda t: t), str(tmp_path / "a")).collect()
    assert {r["id"]: r["state_p"] for r in got} == {"1": 0.1235, "2": None, "3": None}


def test_growing_files(spark, tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    a.write_text("one\ntwo\n")
    b.write_text("äx\n")
    read = lambda df: sorted((r["path"][-5:], r["at"], r["line"]) for r in df.collect())
    lines, at = readers.new_lines(spark, str(tmp_path))
    assert read(lines) == [("a.log", 0, "one"), ("a.log", 4, "two"), ("b.log", 0, "äx")]
    with a.open("a") as f:
        f.write("three\n\nfour\n")
    b.write_text("y\n")
    lines, at = readers.new_lines(spark, str(tmp_path), at)
    assert read(lines) == [("a.log", 8, "three"), ("a.log", 14, ""), ("a.log", 15, "four"), ("b.log", 0, "y")]
    lines, at = readers.new_lines(spark, str(tmp_path), at)
    assert read(lines) == []


def test_rephrased_lines():
    text = "I think so.\nNo `I` here.\nI and I."
    assert code.rephrased(text, r"\bI\b", "Quern") == [(1, "Quern think so."), (3, "Quern and Quern.")]
    assert code.rephrased("fine", r"\bI\b", "Quern") == [] and code.rephrased("", r"\bI\b", "Quern") == []


def test_culprits():
    assert code.culprits(["a", "b", "c"], lambda fs: "b" in fs) == ["b"]
    assert code.culprits(["a", "b", "c"], lambda fs: len(fs) > 1) == ["b", "c"]
    assert code.culprits(["a"], lambda fs: True) == [] and code.culprits(["a"], lambda fs: False) == []


def test_class_stage():
    subs = {1: "x", 2: "y"}
    once = votes.class_stage(subs, None, lambda ids: {"long name": [1, 9], "other": []}, lambda ids, classes: dict.fromkeys(ids, "long name"), {"long name": "short"})
    assert once == [{"class": "short", "class_long": "long name", "subcategories": ["x", "y"]}]
    assert votes.class_stage(subs, once, None, None) == once
    assert votes.class_stage({1: "x"}, once, lambda ids: {"n": ids}, None) == [{"class": "n", "class_long": "n", "subcategories": ["x"]}]
