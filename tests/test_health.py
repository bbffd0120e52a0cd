"""Whether hooks and rules work in a run: hand-made cases of each reason."""

from quern.operators import evaluation


def health(spark, hooks, runs, scores):
    h = spark.createDataFrame(hooks, "hook int, rule string, event string")
    r = spark.createDataFrame(runs, "hook int, turn int, verdict string, message string, seq int")
    s = spark.createDataFrame(scores, "rule string, turn int, passed boolean")
    return evaluation.hook_health(h, r, s, ["Stop", "PreToolUse"])


def test_each_reason(spark):
    hooks = [(1, "R1", "Stop"), (2, "R1", "Display"), (3, "R2", "Stop"), (4, "R3", "PreToolUse"), (5, "R4", "Stop"), (6, None, "Stop"), (7, "R5", "Stop")]
    runs = [
        (1, 1, "pass", None, 1), (1, 2, "deny", "second", 5), (1, 2, "block", "first", 4), (1, 2, "pass", None, 6),  # stopped in turn 2, so it missed nothing
        (2, 1, "pass", None, 1),
        (3, 1, "crash", "Traceback", 9), (3, 1, "crash", "earlier", 3), (3, 2, "pass", None, 10),
        (5, 1, "pass", None, 1), (5, 2, "pass", None, 2), (5, 3, "pass", None, 3), (5, 4, "error", "x", 4),
        (6, 1, "pass", None, 1), (7, 1, "gave up", None, 1),
    ]
    scores = [("R1", 2, False), ("R1", 1, True), ("R2", 1, False), ("R4", 3, False), ("R4", 1, False), ("R4", 1, True), ("R4", 4, False), ("R4", 2, None)]
    got = {r["hook"]: r for r in health(spark, hooks, runs, scores).collect()}
    assert {k: (r["working"], r["status"], r["missed"]) for k, r in got.items()} == {
        1: (True, "stopped the agent 2 times", []), 2: (False, "cannot check the work", []), 3: (False, "crashes", []), 4: (False, "never ran", []),
        5: (False, "errors that nobody is told, missed a violation", [1, 3]), 6: (True, "never had to stop the agent", []), 7: (True, "stopped the agent 1 times", []),
    }
    assert got[1]["said"] == "first" and got[3]["sample"] == "earlier" and got[4]["runs"] == 0 and got[7]["said"] is None
    rules = {r["rule"]: (r["working"], r["stops"], r["why"]) for r in evaluation.rule_health(health(spark, hooks, runs, scores), spark.createDataFrame([(f"R{i}",) for i in range(1, 7)], "rule string")).collect()}
    assert rules == {
        "R1": (True, 2, "hook 2 (Display): cannot check the work"), "R2": (False, 0, "hook 3 (Stop): crashes"), "R3": (False, 0, "hook 4 (PreToolUse): never ran"),
        "R4": (False, 0, "hook 5 (Stop): errors that nobody is told, missed a violation"), "R5": (True, 1, ""), "R6": (False, 0, "no hook was built for this rule"),
    }


def test_no_runs_and_no_hooks(spark):
    assert [r["status"] for r in health(spark, [(1, "R1", "Stop")], [], []).collect()] == ["never ran"]
    assert health(spark, [], [], []).count() == 0


def test_ledger_rows_and_runs(spark):
    rows = spark.createDataFrame([(1, "select"), (2, "select"), (3, "map/all"), (4, None), (5, "other")], "n int, source string")
    runs = spark.createDataFrame([("select",), ("select/translation",), ("map",), ("none",), ("map",)], "label string")
    got = evaluation.ledger_runs(rows, "source", runs, "label")
    assert sorted((r["n"], r["label"]) for r in got.collect()) == [(1, "select"), (1, "select/translation"), (2, "select"), (2, "select/translation"), (3, "map")]
