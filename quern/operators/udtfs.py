"""Checks as SQL table functions: a check takes (text, where) and gives rows (rule, line, message)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quern.functions import grammar
from quern.session import prepare

#: A check: text, where -> (line, message).
Check = Callable[[str, str], Iterable[tuple[int, str]]]


def forbidden(pattern: str, message: str) -> Check:
    """Reports every line in which the expression is found (look-around allowed)."""
    found = re.compile(pattern)
    return lambda text, where: [(i, f"{where}:{i}: {message}: {m[0]}") for i, line in enumerate(text.split("\n"), 1) if (m := found.search(line))]


def required(pattern: str, message: str) -> Check:
    """Reports a text in which the expression is found nowhere."""
    found = re.compile(pattern, re.M)
    return lambda text, where: [] if found.search(text) else [(0, f"{where}: {message}")]


def register(spark: SparkSession, checks: dict[str, Check], name: str = "faults") -> None:
    """`SELECT * FROM t, LATERAL faults(t.text, t.path)`: rule, line, message of every check. A check that fails gives line -1: not made."""
    prepare(spark)

    class Faults:
        def eval(self, text: str, where: str):
            for rule, check in checks.items():
                try:
                    for line, message in check(text or "", where or ""):
                        yield rule, line, message
                except Exception as e:
                    yield rule, -1, f"check failed: {type(e).__name__}"

    spark.udtf.register(name, udtf(Faults, returnType="rule string, line int, message string"))


def register_segments(spark: SparkSession, name: str = "segments") -> None:
    """`SELECT * FROM docs, LATERAL segments(docs.text)`: idx, type, char_start, char_end, text of the grammar's units."""
    prepare(spark)

    class Segments:
        def eval(self, text: str):
            for i, u in enumerate(grammar.segment(text), 1):
                yield i, u.type, u.start, u.end, text[u.start : u.end]

    spark.udtf.register(name, udtf(Segments, returnType="idx int, type string, char_start int, char_end int, text string"))
