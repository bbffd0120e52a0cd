"""Operators that need Python: the grammar, searches by a check. Arrow batches in and out, bounded in bytes on both sides; one pass, no shuffle."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import code, grammar, patterns
from quern.session import prepare


#: What a worker takes from a batch and gives back at once: rows in, rows and characters out. Texts may make many times their own size.
ROWS_IN, ROWS_OUT, CHARS_OUT = 256, 8192, 4 << 20
BATCH_BYTES = 4 << 20


def pieces(rows: Iterable[tuple], most: int = ROWS_OUT, chars: int = CHARS_OUT) -> Iterator[list[tuple]]:
    """Rows in lists of at most so many rows and, but for one row, characters; a list is given away before the next row is made."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        for v in row:
            if type(v) is str:
                size += len(v)
        if len(held) >= most or size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def mapped(df: DataFrame, rows: Callable[[list], Iterable[tuple]], schema: str) -> DataFrame:
    """rows(lists of the columns) -> tuples of the schema, for each batch; given as they come, where rows makes them one by one."""
    prepare(df.sparkSession).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            own = (batch.slice(at, ROWS_IN) for at in range(0, batch.num_rows, ROWS_IN))
            for got in pieces(row for part in own for row in rows([c.to_pylist() for c in part.columns])):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, out)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan is in fewer pieces than there are (one small file); large inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def segmented(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, idx, type, char_start, char_end, text, is_structural, heading_path; a document that fails gives one row of type error."""
    from quern.operators.filters import STRUCTURAL

    def rows(columns: list) -> Iterator[tuple]:
        for k, t in zip(*columns, strict=True):
            try:
                units = grammar.segment(t)
                paths = grammar.heading_paths(grammar.headings(t), units)
            except (RecursionError, IndexError, ValueError) as e:
                yield k, 0, "error", 0, 0, f"{type(e).__name__}: {e}", True, ""
                continue
            for i, (u, path) in enumerate(zip(units, paths, strict=True), 1):
                yield k, i, u.type, u.start, u.end, t[u.start : u.end], u.type in STRUCTURAL, path

    kind = dict(docs.dtypes)[key]
    return mapped(spread(docs.select(key, F.col(text).cast("string"))), rows, f"{key} {kind}, idx int, type string, char_start int, char_end int, text string, is_structural boolean, heading_path string")


def standalone(clauses: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, types, n_units of each clause segmented on its own."""
    kind = dict(clauses.dtypes)[key]

    def rows(columns: list) -> list[tuple]:
        return [(k, *grammar.standalone(t)) for k, t in zip(*columns, strict=True)]

    return mapped(spread(clauses.select(key, F.col(text).cast("string"))), rows, f"{key} {kind}, types array<string>, n_units int")


def clauses_in_context(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Clauses (no structure) with the lines around them and their content-addressed id: key, clause_id, text, text_sha, char_start, char_end, context, ctx_start_line, ctx_end_line, heading_path."""
    from quern.operators.filters import STRUCTURAL

    def digest(*parts: object) -> str:
        return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:16]

    def rows(columns: list) -> Iterator[tuple]:
        for k, t in zip(*columns, strict=True):
            units = [u for u in grammar.segment(t) if u.type not in STRUCTURAL]
            if units:
                lines, sha = t.split("\n"), hashlib.sha256(t.encode()).hexdigest()
                mask, starts = grammar.fence_mask(lines), list(accumulate((len(x) + 1 for x in lines), initial=0))
                for u, path in zip(units, grammar.heading_paths(grammar.headings(t), units), strict=True):
                    first, last = bisect_right(starts, u.start) - 1, bisect_right(starts, u.end) - 1
                    own = t[u.start : u.end]
                    yield k, digest(sha, u.start, u.end), own, digest(re.sub(r"\s+", " ", own).strip()), u.start, u.end, *grammar.context(lines, mask, first, last), path

    kind = dict(docs.dtypes)[key]
    return mapped(spread(docs.select(key, F.col(text).cast("string"))), rows, f"{key} {kind}, clause_id string, text string, text_sha string, char_start int, char_end int, context string, ctx_start_line int, ctx_end_line int, heading_path string")


def prose_contexts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, first, last, context of each line outside code: the nearest lines of prose around it, up to the headings that bound it."""

    def rows(columns: list) -> Iterator[tuple]:
        for k, t in zip(*columns, strict=True):
            lines = (t or "").split("\n")
            mask = grammar.fence_mask(lines)
            for i in (i for i, inside in enumerate(mask) if not inside):
                block, first, last = grammar.context(lines, mask, i, i)
                yield k, i + 1, first, last, block

    kind = dict(docs.dtypes)[key]
    return mapped(spread(docs.select(key, F.col(text).cast("string"))), rows, f"{key} {kind}, line long, first long, last long, context string")


def fence_masks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, mask: a sign for each line, 1 inside fenced code and on its fences. A fence is closed by its own mark only."""
    kind = dict(docs.dtypes)[key]
    rows = lambda c: [(k, "".join("01"[bool(x)] for x in grammar.fence_mask((t or "").split("\n")))) for k, t in zip(*c, strict=True)]
    return mapped(spread(docs.select(key, F.col(text).cast("string"))), rows, f"{key} {kind}, mask string")


def rephrased(replies: DataFrame, keys: Sequence[str], text: str, pattern: str, replacement: str, most: int = 12) -> DataFrame:
    """keys, n_lines, fixed: lines of own prose that hold a forbidden expression, and the first `most` of them as they should read."""

    def rows(columns: list) -> list[tuple]:
        *names, texts = columns
        found = [code.rephrased(t or "", pattern, replacement) for t in texts]
        return [(*k, len(f), [f"{n}: {line}" for n, line in f[:most]]) for k, f in zip(zip(*names, strict=True), found, strict=True) if f]

    kinds = dict(replies.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return mapped(replies.select(*keys, F.col(text).cast("string")), rows, f"{schema}, n_lines long, fixed array<string>")


def plain_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, plain: inline markdown resolved; null stays."""
    kind = dict(df.dtypes)[key]
    return mapped(df.select(key, text), lambda c: [(k, None if t is None else grammar.plain(t)) for k, t in zip(*c, strict=True)], f"{key} {kind}, plain string")


def long_functions(files: DataFrame, most: int) -> DataFrame:
    """path, name, line, lines of functions longer than `most`; files: path, content."""
    rows = lambda c: [(p, *f) for p, t in zip(*c, strict=True) for f in code.function_lengths(p or "", t or "") if f[2] > most]
    return mapped(files.select("path", "content"), rows, "path string, name string, line int, lines int")


def violations(texts: DataFrame, key: str, text: str, fails: Callable[[Sequence[str]], bool], most: int | None = None) -> DataFrame:
    """key, first, last, note, lines, checks: the places at fault in each text that fails a check of lines, each 1-minimal (its line numbers in
    `lines`), and how many checks the text took."""
    kind = dict(texts.dtypes)[key]

    def rows(columns: list) -> Iterator[tuple]:
        for k, t in zip(*columns, strict=True):
            found, checks = code.located((t or "").split("\n"), fails, most)
            yield from ((k, at[0], at[-1], note, at, checks) for at, note in found)

    return mapped(texts.select(key, text), rows, f"{key} {kind}, first int, last int, note string, lines array<int>, checks int")


def pattern_matches(files: DataFrame, rules: Sequence[tuple[str, str, str, int]]) -> DataFrame:
    """path, rule, line, end_line, holes, measure, broken of what matches each rule in files (path, content).

    rules: (name, pattern with $holes, measure, the most that it allows); see functions/patterns."""
    for _, pattern, measure, _ in rules:
        patterns.parsed(pattern), patterns.MEASURES[measure]  # a rule that can't be read fails here, not in a task

    def rows(columns: list) -> list[tuple]:
        return [(p, name, a, z, list(holes.items()), n, n > most) for p, t in zip(*columns, strict=True) for name, pattern, measure, most in rules for a, z, holes, n in patterns.measured(t or "", pattern, measure)]

    return mapped(files.select("path", "content"), rows, "path string, rule string, line int, end_line int, holes map<string, string>, measure int, broken boolean")


def shuffled(df: DataFrame, key: str, values: str) -> DataFrame:
    """key, values in an order that depends on the key only."""
    kinds = dict(df.dtypes)
    rows = lambda c: [(k, [v[i] for i in code.seeded_order(str(k), len(v))]) for k, v in zip(*c, strict=True)]
    return mapped(df.select(key, values), rows, f"{key} {kinds[key]}, {values} {kinds[values]}")
