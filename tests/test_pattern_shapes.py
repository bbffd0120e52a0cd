"""Patterns over files alike but for plain numbers and strings: one is parsed for all, and each has the matches of a tree of its own."""

import ast
import itertools

import pytest

from quern.functions import patterns

RULES = [("if check($K, 'R'):\n    drop($K)", "lines"), ("check($ANY, $FLAG)", "width"), ("def $F(*_any):\n    ...\n    return $X", "statements"), ("f($X, ..., $X)", "lines"), ("$X", "lines")]


@pytest.fixture
def parses(monkeypatch):
    """What is parsed, from an empty store of shapes on."""
    seen, parse = [], ast.parse
    for pattern, _ in RULES:
        patterns.parsed(pattern)
    monkeypatch.setattr(patterns, "SHARED", patterns.Shapes())
    monkeypatch.setattr(patterns.ast, "parse", lambda source: seen.append(source) or parse(source))
    return seen


def alone(content, pattern, measure):
    """As measured, with a tree of the file's own and all ways of matching tried."""
    tree, lines, body = compile(content, "x", "exec", ast.PyCF_ONLY_AST), content.split("\n"), patterns.parsed(pattern)
    found = []
    for node in ast.walk(tree):
        if len(body) == 1 and isinstance(body[0], ast.Expr):
            if isinstance(node, ast.expr) and (b := next(patterns.fits(body[0].value, node, {}), None)) is not None:
                found.append((node.lineno, node.end_lineno, b))
        else:
            for block in (x for f in ("body", "orelse", "finalbody") if isinstance(x := getattr(node, f, None), list)):
                for i in range(len(block) - len(body) + 1):
                    if (b := next(patterns.statement_run(body, own := block[i : i + len(body)]), None)) is not None:
                        found.append((own[0].lineno, own[-1].end_lineno, b))
    text = lambda v: v if isinstance(v, str) else v.id if isinstance(v, ast.Name) else ast.unparse(v)
    made = [(a, z, {k: text(v) for k, v in b.items()}) for a, z, b in found]
    return sorted(((a, z, b, patterns.MEASURES[measure](lines[a - 1 : z], b)) for a, z, b in made), key=lambda m: (m[0], m[1], sorted(m[2].items())))


def test_files_of_one_shape_are_parsed_once(parses):
    files = [f"def order():\n    if check({k}, '{flag}'):\n        drop({n})\n    f({n}, 'é', {k})\n    return 1\n" for k, n, flag in itertools.product((7, 12345, 0), (7, 12345, 0), ("R", "", "A b"))]
    got = [[patterns.measured(c, p, m) for p, m in RULES] for c in files]
    assert parses[0] == files[0] and files[1] not in parses and len([x for x in parses if x in files]) == 1
    assert got == [[alone(c, p, m) for p, m in RULES] for c in files]
    assert [len(x[0]) for x in got] == [int(k == n and flag == "R") for k, n, flag in itertools.product((7, 12345, 0), (7, 12345, 0), ("R", "", "A b"))]


@pytest.mark.parametrize(
    "line",
    ["check({0}, 2)  # {1}", "check({0}, f'{1}')", "check({0}, f'{{{1}=}}')", "check({0}, 'it\\'s {1}')", "check({0}, '1' '{1}')", "check({0}, '''{1}''')", "check({0}, b'{1}')", "check({0}, x{1})", "check({0}, {1}.5)", "check({0}, 0x{1})", "check({0}, u'{1}')", "check('{0}', -{1})", "check(\"{0}\", 1 if {1} else 2)", "x = ({0},\n  {1}); check({0}, {1})", "check({0}, 99999999999999999999{1})", "check({0}, é{1})"],
)
def test_what_is_no_plain_token_keeps_its_value(parses, line):
    for values in [(1, 2), (3, 2), (3, 3), (1, 44), (1, 1)]:
        content = "def g():\n    " + line.format(*values) + "\n    return 1\n"
        for p, m in RULES:
            assert patterns.measured(content, p, m) == alone(content, p, m)


def test_no_more_shapes_are_kept_than_allowed(parses):
    for n in range(3 * patterns.SHAPES):
        assert patterns.measured(f"v{n} = 1\n", "$X = 1")[0][2] == {"X": f"v{n}"}
    assert len(patterns.SHARED.kept) <= patterns.SHAPES
    assert patterns.measured("x = (\n", "$X = 1") == [] == patterns.measured("x = (\n", "$X")
    long = "x = 1\n" * patterns.SHAPE_CHARS
    assert len(patterns.measured(long, "x = 1")) == patterns.SHAPE_CHARS and len(patterns.SHARED.kept) <= patterns.SHAPES


def test_a_tree_of_ones_own_is_not_filled_by_others(parses):
    first = patterns.tree_of("f(1, 2)\n")
    patterns.measured("f(1, 2)\n", "$X")
    patterns.measured("f(3, 4)\n", "$X")
    assert ast.unparse(first) == "f(1, 2)" == ast.unparse(patterns.tree_of("f(1, 2)\n"))
