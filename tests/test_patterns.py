"""Code patterns with holes, and places at fault: against hand-made cases and the definition of 1-minimal."""

import random

import pytest

from quern.functions import code, patterns
from quern.operators import python_backed

CODE = '''import os

class Box:
    def size(self, a, b=2):
        x = os.path.join(a, b)
        if a == a:
            return x
        print("one", x, sep="")
        return None

def outer():
    def inner(y):
        try:
            call(y, y + 1)
        finally:
            call(y, 2)
        return y
    total = 0
    for i in range(3):
        total = total + i
    return inner(total)
'''


@pytest.mark.parametrize(
    "pattern, found",
    [
        ("call($X, $Y)", [(14, 14, {"X": "y", "Y": "y + 1"}), (16, 16, {"X": "y", "Y": "2"})]),
        ("call($X, $X + 1)", [(14, 14, {"X": "y"})]),
        ("$A == $A", [(6, 6, {"A": "a"})]),
        ("print(..., sep=$S)", [(8, 8, {"S": "''"})]),
        ("os.path.join(...)", [(5, 5, {})]),
        ("$F(..., 2)", [(16, 16, {"F": "call"})]),
        ("def $F(self, ...): ...", []),  # ... is no parameter
        ("def $F(*_any):\n    ...\n    return $F($X)", []),
        ("def $F(*_any):\n    ...\n    return $X", [(4, 9, {"F": "size", "X": "None"}), (11, 21, {"F": "outer", "X": "inner(total)"}), (12, 17, {"F": "inner", "X": "y"})]),
        ("def $F($P):\n    ...", [(12, 17, {"F": "inner", "P": "y"})]),
        ("$T = 0\nfor $I in $R:\n    $T = $T + $I", [(18, 20, {"T": "total", "I": "i", "R": "range(3)"})]),
        ("try:\n    ...\nfinally:\n    call($Y, 2)", [(13, 16, {"Y": "y"})]),
        ("class $C:\n    ...", [(3, 9, {"C": "Box"})]),
        ("absent($X)", []),
    ],
)
def test_matches(pattern, found):
    if "self, ..." in pattern:
        with pytest.raises(SyntaxError):
            patterns.measured(CODE, pattern)
        return
    assert [(a, z, b) for a, z, b, _ in patterns.measured(CODE, pattern)] == found


def test_measures():
    function = "def $F(*_any):\n    ..."
    of = lambda measure: {b["F"]: n for _, _, b, n in patterns.measured(CODE, function, measure)}
    assert of("lines") == {"size": 6, "outer": 11, "inner": 6} and of("statements") == {"size": 6, "inner": 5, "outer": 10}
    assert of("width")["size"] == len("        print(\"one\", x, sep=\"\")")
    assert patterns.measured("# a\ndef f():\n\n    # b\n    return 1\n", function, "code_lines")[0][3] == 2
    assert patterns.measured("not python at all (", function) == [] and patterns.measured("", function) == []


def test_rules_over_files(spark):
    files = spark.createDataFrame([("a.py", CODE), ("b.py", "broken ("), ("c.py", None), ("d.js", "function f() {}")], "path string, content string")
    got = python_backed.pattern_matches(files, [("long", "def $F(*_any):\n    ...", "lines", 6), ("calls", "call(...)", "lines", 1)]).collect()
    assert sorted((r["rule"], r["line"], r["holes"].get("F"), r["measure"], r["broken"]) for r in got) == [("calls", 14, None, 1, False), ("calls", 16, None, 1, False), ("long", 4, "size", 6, False), ("long", 11, "outer", 11, True), ("long", 12, "inner", 6, False)]
    with pytest.raises(SyntaxError):
        python_backed.pattern_matches(files, [("bad", "def (", "lines", 1)])


def test_places_are_minimal_and_complete():
    rng = random.Random(12)
    for _ in range(300):
        n = rng.randint(1, 40)
        faults = [frozenset(rng.sample(range(n), min(n, rng.choice((1, 1, 2, 3))))) for _ in range(rng.randint(0, 4))]
        calls = []

        def fails(lines, faults=faults, calls=calls):
            calls.append(1)
            have = set(lines)
            return any(f <= have for f in faults)

        found, checks = code.located(list(range(n)), fails)
        assert checks == len(calls)
        left = set(range(n))
        for place, note in found:
            own = {i - 1 for i in place}
            if note != "line count":
                assert any(own == f for f in faults) and own <= left  # a fault, and no more than it
            left -= own
        assert not any(f <= left for f in faults)


def test_one_line_takes_few_checks():
    found, checks = code.located(["ok"] * 5000 + ["bad"] + ["ok"] * 3000, lambda lines: "bad" in lines)
    assert found == [([5001], "line")] and checks < 40
