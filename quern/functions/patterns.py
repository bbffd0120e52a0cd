"""Patterns of Python code with named holes, matched over syntax trees, and measures of what matches. Plain Python, one file at a time.

A pattern is Python code in which $NAME stands for any expression or name (the same text wherever it stands again) and ... for any run of statements,
arguments, elements or decorators. An expression matches expressions anywhere; a statement matches statements; several statements
match a run within one block.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from itertools import pairwise
from operator import attrgetter

HOLE = "_hole_"
Bindings = dict[str, str]
Match = Callable[[object, "Held"], bool]

#: Fields that aren't asked for, and those that hold no statement or expression.
UNASKED = ("ctx", "type_comment", "kind", "type_params")
PLAIN = {"ctx", "op", "ops", "id", "attr", "kind", "type_comment"}
#: Constants that are equal where their values and types are, and read as their repr.
EXACT = (int, str, bytes, bool, type(None))


@cache
def parsed(pattern: str) -> list[ast.stmt]:
    return ast.parse(re.sub(r"\$([A-Za-z_]\w*)", rf"{HOLE}\1", pattern)).body


def any_run(node: object) -> bool:
    node = node.value if isinstance(node, ast.Expr) else node
    return isinstance(node, ast.Constant) and node.value is ...


def same(a: object, b: object) -> bool:
    if isinstance(a, ast.Name) and isinstance(b, ast.Name):
        return a.id == b.id
    if isinstance(a, ast.Constant) and isinstance(b, ast.Constant) and type(a.value) in EXACT:
        return type(a.value) is type(b.value) and a.value == b.value and a.kind == b.kind
    return type(a) is type(b) and (a == b if isinstance(a, str) else ast.dump(a) == ast.dump(b))


def bound(name: str, part: object, bindings: dict) -> Iterator[dict]:
    if name not in bindings:
        yield bindings | {name: part}
    elif same(bindings[name], part):
        yield bindings


def text_of(part: object) -> str:
    kind = type(part)
    if kind is ast.Constant and type(part.value) in EXACT and part.kind is None:
        return repr(part.value)
    return part if kind is str else part.id if kind is ast.Name else ast.unparse(part)


def texts(bindings: dict) -> Bindings:
    return {k: text_of(v) for k, v in bindings.items()}


def fits(want: object, have: object, bindings: dict) -> Iterator[dict]:
    """All ways in which a part of the pattern matches a part of the tree."""
    if isinstance(want, ast.Expr) and isinstance(want.value, ast.Name) and want.value.id.startswith(HOLE) and isinstance(have, ast.stmt):
        yield from bound(want.value.id[len(HOLE) :], have, bindings)
    elif isinstance(want, ast.Name) and want.id.startswith(HOLE):
        if isinstance(have, ast.expr):
            yield from bound(want.id[len(HOLE) :], have, bindings)
    elif isinstance(want, str) and want.startswith(HOLE):
        if isinstance(have, str):
            yield from bound(want[len(HOLE) :], have, bindings)
    elif isinstance(want, list):
        if isinstance(have, list):
            yield from runs(want, have, bindings)
    elif isinstance(want, ast.Name):
        if isinstance(have, ast.Name) and want.id == have.id:
            yield bindings
    elif isinstance(want, ast.AST):
        if type(want) is type(have):
            yield from fields(want, have, [f for f in want._fields if f not in UNASKED], bindings)
    elif want == have and type(want) is type(have):
        yield bindings


def fields(want: ast.AST, have: ast.AST, names: list[str], bindings: dict) -> Iterator[dict]:
    if not names:
        yield bindings
        return
    w, h = getattr(want, names[0]), getattr(have, names[0])
    # a signature or a decorator list that the pattern leaves out isn't asked for
    found = [bindings] if names[0] in ("decorator_list", "returns") and not w else fits(w, h, bindings)
    for b in found:
        yield from fields(want, have, names[1:], b)


def runs(want: list, have: list, bindings: dict) -> Iterator[dict]:
    if not want:
        if not have:
            yield bindings
    elif any_run(want[0]):
        rest = want[1:]
        fixed = sum(not any_run(w) for w in rest)  # what follows takes so many at least, and no more where it has no run
        for k in range(len(have) - fixed if fixed == len(rest) else 0, len(have) - fixed + 1):
            if k >= 0:
                yield from runs(rest, have[k:], bindings)
    elif have:
        for b in fits(want[0], have[0], bindings):
            yield from runs(want[1:], have[1:], b)


class Held(dict):
    """Bindings of a place, and what is left to ask there of constants whose values change: those that have to be of a value, and parts that have to be the same."""

    def __init__(self, changing: frozenset[int]) -> None:
        self.changing, self.asked, self.pairs = changing, [], []

    def holds(self) -> bool:
        for node, value in self.asked:
            if node.value != value:
                return False
        for a, b in self.pairs:
            if not same(a, b):
                return False
        return True


def single(want: object) -> Match | None:
    """fits() as one call that adds to the bindings, for a part of a pattern that can match in one way only; else None.

    Where it fails the whole pattern does, so what was bound on the way is of no use; where it doesn't, holds() decides."""
    if is_hole(want) or (isinstance(want, str) and want.startswith(HOLE)):
        kind, name = (ast.stmt, want.value.id) if isinstance(want, ast.Expr) else (ast.expr, want.id) if isinstance(want, ast.Name) else (str, want)
        name = name[len(HOLE) :]

        def bind(have: object, held: Held) -> bool:
            if not isinstance(have, kind):
                return False
            if name in held:
                held.pairs.append((held[name], have))
            else:
                held[name] = have
            return True

        return bind
    if isinstance(want, list):
        return single_run(want)
    if isinstance(want, ast.Name):
        own = want.id
        return lambda have, held: type(have) is ast.Name and have.id == own
    if isinstance(want, ast.Constant):
        return single_constant(want.value)
    if isinstance(want, ast.AST):
        return single_fields(want, [f for f in want._fields if f not in UNASKED])
    return lambda have, held: have == want and type(have) is type(want)


def single_constant(value: object) -> Match | None:
    kind = type(value)
    if kind is str and value.startswith(HOLE):
        return None  # it holds the value itself, which may change

    def constant(have: object, held: Held) -> bool:
        if type(have) is not ast.Constant or type(have.value) is not kind:
            return False
        if id(have) in held.changing:
            held.asked.append((have, value))
            return True
        return have.value == value

    return constant


def single_fields(want: ast.AST, names: list[str]) -> Match | None:
    parts = [(f, single(w)) for f in names if (w := getattr(want, f)) or f not in ("decorator_list", "returns")]
    if any(m is None for _, m in parts):
        return None
    kind = type(want)

    def asked(have: object, held: Held) -> bool:
        if type(have) is not kind:
            return False
        for f, m in parts:
            if not m(getattr(have, f), held):
                return False
        return True

    return asked


def single_run(want: list) -> Match | None:
    """A list with one run at most: what stands before and behind it has its place."""
    if not want:
        return lambda have, held: type(have) is list and not have
    at = [i for i, w in enumerate(want) if any_run(w)]
    fixed = [(i if not at or i < at[0] else i - len(want), single(w)) for i, w in enumerate(want) if i not in at]
    if len(at) > 1 or any(m is None for _, m in fixed):
        return None
    least, most = len(fixed), float("inf") if at else len(fixed)

    def placed(have: object, held: Held) -> bool:
        if type(have) is not list or not least <= len(have) <= most:
            return False
        for i, m in fixed:
            if not m(have[i], held):
                return False
        return True

    return placed


@cache
def steps_of(pattern: str) -> list[Match] | None:
    """One call for each statement of a pattern, or for its expression, where it can match in one way only."""
    body = parsed(pattern)
    if len(body) == 1 and isinstance(body[0], ast.Expr):
        steps = [single(body[0].value)]
    else:
        steps = [single_fields(w, signature_free(w)) if any_arguments(w) else single(w) for w in body]
    return None if any(m is None for m in steps) else steps


def ways(pattern: str, have: list) -> Iterator[dict]:
    """All ways in which nodes, as many as the pattern's statements or one expression, match it."""
    body = parsed(pattern)
    return fits(body[0].value, have[0], {}) if len(body) == 1 and isinstance(body[0], ast.Expr) else statement_run(body, have)


def any_arguments(want: ast.stmt) -> bool:
    """def f(...): the only argument is a run, which the syntax lets stand as *_any."""
    return isinstance(want, ast.FunctionDef | ast.AsyncFunctionDef) and want.args.vararg is not None and want.args.vararg.arg == "_any"


def signature_free(want: ast.stmt) -> list[str]:
    return [f for f in want._fields if f not in ("args", "type_comment", "type_params")]


@cache
def parts_of(kind: type) -> tuple[str, ...]:
    """The fields of a kind of node that may hold nodes."""
    return () if kind is ast.Constant else tuple(f for f in kind._fields if f not in PLAIN)


LINE = attrgetter("lineno")


class Walked:
    """A tree walked once for all rules: its nodes but contexts and signs, level by level as ast.walk has them, also by kind; its blocks; its statements by line."""

    def __init__(self, tree: ast.AST) -> None:
        self.nodes, self.kinds, self.blocks = [tree], {}, []
        self.counts: dict[tuple[int, int], int | None] = {}
        for node in self.nodes:  # which grows meanwhile
            kind = type(node)
            self.kinds.setdefault(kind, []).append(node)
            names = parts_of(kind)
            for f in names:
                part = getattr(node, f, None)
                if type(part) is list:
                    self.nodes += [x for x in part if isinstance(x, ast.AST)]
                elif isinstance(part, ast.AST):
                    self.nodes.append(part)
            if "body" in names:
                self.blocks += [block for f in ("body", "orelse", "finalbody") if isinstance(block := getattr(node, f, None), list)]
        self.changing: frozenset[int] = frozenset()  # the ids of constants whose values change from file to file
        self.held: dict[str, list[tuple[int, int, list[ast.AST], Held | None]]] = {}
        self.statements = sorted((n for kind, nodes in self.kinds.items() if issubclass(kind, ast.stmt) for n in nodes), key=LINE)


    def places(self, pattern: str) -> list[tuple[int, int, list[ast.AST], Held | None]]:
        """(first line, last line, nodes, bindings) of each place that can match, whatever the values that change; without bindings where there may be several ways."""
        if pattern not in self.held:
            body = parsed(pattern)
            if len(body) == 1 and isinstance(body[0], ast.Expr):
                found = [[n] for n in self.nodes if isinstance(n, ast.expr)] if is_hole(body[0]) else [[n] for n in self.kinds.get(type(body[0].value), ())]
            else:
                kinds = [object if is_hole(w) else type(w) for w in body]
                runs = (block[i : i + len(body)] for block in self.blocks for i in range(len(block) - len(body) + 1))
                found = [own for own in runs if all(k is object or type(h) is k for k, h in zip(kinds, own, strict=True))]
            steps, fit = steps_of(pattern), []
            for own in found:
                held = None if steps is None else Held(self.changing)
                if held is None or all(m(h, held) for m, h in zip(steps, own, strict=True)):
                    fit.append((own[0].lineno, own[-1].end_lineno or own[-1].lineno, own, held))
            self.held[pattern] = fit
        return self.held[pattern]


@lru_cache(maxsize=2)
def walked(tree: ast.AST) -> Walked:
    return Walked(tree)


def statements_within(tree: ast.AST | Walked, lines: list[str], a: int, z: int) -> int | None:
    """How many statements begin in lines a to z, where these would read on their own as they do in the file; else None."""
    tree = tree if isinstance(tree, Walked) else walked(tree)
    if (a, z) not in tree.counts:
        tree.counts[a, z] = counted(tree.statements, lines[a - 1 : z], a, z)
    return tree.counts[a, z]


def counted(known: list[ast.stmt], part: list[str], a: int, z: int) -> int | None:
    own = known[bisect_left(known, a, key=LINE) : bisect_right(known, z, key=LINE)]
    margin = min((len(x) - len(x.lstrip()) for x in part if x.strip()), default=0)
    whole = own and all(n.end_lineno <= z for n in own) and min((n.lineno, n.col_offset) for n in own) == (a, margin) and len(part[0]) - len(part[0].lstrip(" ")) == margin
    return len(own) if whole and not part[0].startswith("elif", margin) and not any(c in x for x in part for c in "\t\r\f") else None


def is_hole(want: object) -> bool:
    want = want.value if isinstance(want, ast.Expr) else want
    return isinstance(want, ast.Name) and want.id.startswith(HOLE)


def matches(pattern: str, tree: ast.AST | Walked) -> Iterator[tuple[int, int, Bindings]]:
    """(first line, last line, what the holes hold) of each place that matches, in order; one way of matching a place. `*_any` in a signature is any signature."""
    for a, z, own, held in (tree if isinstance(tree, Walked) else walked(tree)).places(pattern):
        if held is None:
            held = next(ways(pattern, own), None)
        elif not held.holds():
            continue
        if held is not None:
            yield a, z, texts(held)


def statement_run(want: list[ast.stmt], have: list[ast.stmt]) -> Iterator[dict]:
    held: list[dict] = [{}]
    for w, h in zip(want, have, strict=True):
        if any_arguments(w) and type(w) is type(h):
            held = [c for b in held for c in fields(w, h, signature_free(w), b)]
        else:
            held = [c for b in held for c in fits(w, h, b)]
    yield from held


#: Measures by name: of the source lines of a match and its bindings.
MEASURES: dict[str, Callable[[list[str], Bindings], int]] = {
    "lines": lambda lines, holes: len(lines),
    "statements": lambda lines, holes: statements("\n".join(lines)),
    "width": lambda lines, holes: max(map(len, lines)),
    "code_lines": lambda lines, holes: sum(bool(x.strip()) and not x.strip().startswith("#") for x in lines),
}


def statements(source: str) -> int:
    margin = min((len(x) - len(x.lstrip()) for x in source.split("\n") if x.strip()), default=0)
    try:
        tree = ast.parse("\n".join(x[margin:] for x in source.split("\n")))
    except SyntaxError:
        return 1  # an expression out of a longer line
    return sum(isinstance(n, ast.stmt) for n in ast.walk(tree))


def tree_of(content: str) -> ast.Module | None:
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return None


# Plain numbers and plain strings, each sure to be one token wherever code may begin one: no prefix, no escape, no other quote, nothing that goes on.
PLAIN_TOKEN = re.compile(r"""((?<![\w.])(?:0|[1-9][0-9]{0,17})(?![\w.])|(?<![\w'"])(?:'[ -!#-&(-\[\]-~]*'|"[ -!#-&(-\[\]-~]*")(?!['"]))""")
#: Trees kept for files that differ in such tokens only, and the longest file that one is kept for.
SHAPES, SHAPE_CHARS = 64, 4096


class Shapes:
    """Trees of files. Of files alike but for plain numbers and strings the first alone is parsed and walked; for the others its tree is given their values.

    A tree is good until the next one is asked for; the last is kept for the next rule."""

    def __init__(self) -> None:
        self.kept: dict[tuple, tuple[Walked, list[ast.Constant]] | None] = {}  # None: not to be shared; the one used last stands last
        self.last: tuple[str, Walked | None] | None = None

    def of(self, content: str) -> Walked | None:
        if self.last is None or self.last[0] != content:
            self.last = None  # a tree half filled isn't to be used
            self.last = content, self.shared(content) if len(content) <= SHAPE_CHARS else self.parsed(content)
        return self.last[1]

    def parsed(self, content: str) -> Walked | None:
        return None if (tree := tree_of(content)) is None else Walked(tree)

    def shared(self, content: str) -> Walked | None:
        parts = PLAIN_TOKEN.split(content)
        tokens = parts[1::2]
        shape = tuple(parts[::2]), "".join([t[0] if t[0] in "'\"" else "0" for t in tokens])
        if shape in self.kept:
            self.kept[shape] = found = self.kept.pop(shape)
            if found is None:
                return self.parsed(content)
            for node, t in zip(found[1], tokens, strict=True):
                node.value = t[1:-1] if t[0] in "'\"" else int(t)
            return found[0]
        tree = self.parsed(content)
        places = None if tree is None else token_nodes(tree, parts)
        self.kept[shape] = None
        if places is not None:
            tree.changing = frozenset(map(id, places))
            self.kept[shape] = tree, places
        if len(self.kept) > SHAPES:
            del self.kept[next(iter(self.kept))]
        return tree


def token_nodes(tree: Walked, parts: list[str]) -> list[ast.Constant] | None:
    """The constant that each token (every second part of a file) is in its tree; None where one isn't just that, as in a comment or a longer string."""
    if any(type(n).__name__ in ("JoinedStr", "TemplateStr") for n in tree.nodes):
        return None  # which may hold a token's text once more
    at = {(n.lineno, n.col_offset, n.end_lineno, n.end_col_offset): n for n in tree.kinds.get(ast.Constant, ())}
    found, line, column = [], 1, 0
    for i, part in enumerate(parts):
        width = len(part.encode("utf-8", "surrogatepass"))
        if i % 2:
            node = at.get((line, column, line, column + width))
            if node is None or type(node.value) not in (int, str) or node.value != (part[1:-1] if part[0] in "'\"" else int(part)):
                return None
            found.append(node)
        if "\n" in part:
            line, column = line + part.count("\n"), len(part.rpartition("\n")[2].encode("utf-8", "surrogatepass"))
        else:
            column += width
    return found


SHARED = Shapes()

def measured(content: str, pattern: str, measure: str = "lines") -> list[tuple[int, int, Bindings, int]]:
    """(first line, last line, holes, measure) of each match, by line; none in a file that can't be parsed."""
    if (tree := SHARED.of(content)) is None:
        return []
    lines = content.split("\n")

    def measure_of(a: int, z: int, holes: Bindings) -> int:
        known = statements_within(tree, lines, a, z) if measure == "statements" and "\r" not in content else None
        return MEASURES[measure](lines[a - 1 : z], holes) if known is None else known

    found = [(a, z, b, measure_of(a, z, b)) for a, z, b in matches(pattern, tree)]
    return found if all(m[0] < n[0] for m, n in pairwise(found)) else sorted(found, key=lambda m: (m[0], m[1], sorted(m[2].items())))
