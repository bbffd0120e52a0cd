"""Patterns: each file is parsed and walked once, whatever the rules; statements are counted on its tree where that gives the same."""

import ast

import pytest

from quern.functions import patterns

FILES = [
    "def f():\n    a = 1\n    if a:\n        b = 2\n    elif f():\n        c = 3\n    return a\n",
    "class A:\n    @x\n    def f(self, *a):\n        s = '''\nout\n'''\n        return s\n\n    def g(self):\n        pass; y = (1,\n          2)\n        return y\n",
    "def f(): return 1\ndef g():\n    x = 1; return x\nif f(): g(); z = 1\n",
    "async def f():\n\tx = 1\n\treturn x\n",
]


@pytest.mark.parametrize("content", FILES)
def test_statements_from_the_tree_are_those_of_the_lines(content):
    tree, lines = patterns.tree_of(content), content.split("\n")
    for node in (n for n in ast.walk(tree) if isinstance(n, ast.stmt)):
        known = patterns.statements_within(tree, lines, node.lineno, node.end_lineno)
        assert known in (None, patterns.statements("\n".join(lines[node.lineno - 1 : node.end_lineno])))


def test_a_file_is_parsed_once(monkeypatch):
    parsed = []
    parse = ast.parse
    content = "def order():\n    if check(1, 'R'):\n        drop(1)\n    return 7\n"
    rules = [("if check($K, 'R'):\n    drop($K)", "lines"), ("def $F(*_any):\n    ...\n    return $X", "statements")]
    for pattern, _ in rules:
        patterns.parsed(pattern)
    monkeypatch.setattr(patterns.ast, "parse", lambda source: parsed.append(source) or parse(source))
    assert [patterns.measured(content, p, m)[0][3] for p, m in rules] == [2, 4]
    assert parsed == [content]


def test_runs_between_what_is_fixed():
    tree = ast.parse("a(1)\nb(2)\na(3)\nb(4)\n")
    whole = patterns.parsed("...\n$A(1)\n...\nb($X)\n...")
    assert [b["X"].value for b in patterns.runs(whole, tree.body, {})] == [2, 4]
    assert not list(patterns.runs(patterns.parsed("...\na(1)\nb(2)\na(3)\nb(4)\nc()"), tree.body, {}))
