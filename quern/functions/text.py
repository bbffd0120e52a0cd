"""Text functions as Column expressions: everything here stays in the JVM and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shortest unit of text: letters and digits it must hold.
MIN_ALNUM = 3


def collapse(x: Column) -> Column:
    """Runs of white space (Unicode too) to one space, trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def drop_marker(x: Column) -> Column:
    """Without a leading list marker or number."""
    return F.regexp_replace(x, r"\A\s*(?:[-*+]|\d+[.)])\s+", "")


def norm(x: Column) -> Column:
    """Key of a free-text value: lower case, no quotes, no trailing parenthesis, one space for runs of space - _ /, no edge punctuation."""
    plain = F.regexp_replace(F.lower(x), "[\"'`‘’“”]", "")
    plain = F.regexp_replace(plain, r"\s*\([^()]*\)\s*\z", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[\s\-_/]+", " "), r"\A[ .;:]+|[ .;:]+\z", "")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def table_cells(x: Column) -> Column:
    """A table row's pipes to spaced bars, edges dropped."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"\A\|\s*|\s*\|\z", ""), r"\s*\|\s*", " | ")


def n_alnum(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def worth_keeping(x: Column) -> Column:
    return n_alnum(x) >= MIN_ALNUM


def n_words(x: Column) -> Column:
    """Words between white space; null and empty: 0."""
    return F.coalesce(F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")), F.lit(0))


def is_lead_in(x: Column) -> Column:
    """Whether the last character, but for emphasis, quotes and blanks, is a colon."""
    return x.rlike("[:：][*_ \\t\\r\"']*\\z")


def is_field_meta(x: Column) -> Column:
    """Whether a front-matter leaf is machine data: under four words, and a key or no sentence end."""
    t = F.regexp_replace(F.trim(x), r"\A\s*[-*+]\s+", "")
    keyed = t.rlike(r"\A[A-Za-z_][\w-]*\s*:")
    value = F.when(keyed, F.regexp_extract(t, r"(?s)\A[A-Za-z_][\w-]*\s*:\s*(.*)\z", 1)).otherwise(t)
    words = F.size(F.filter(F.split(value, r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))
    return (words < 4) & (keyed | ~value.rlike("[.!?。！？]"))


def truncated(x: Column, n: int) -> Column:
    """At most n characters, and how many more there are."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(" … "), (F.length(x) - n).cast("string"), F.lit(" more"))).otherwise(x)


def first_line(x: Column) -> Column:
    return F.element_at(F.split(x, "\n"), 1)


def quoted_parts(x: Column) -> Column:
    """Distinct parts between straight double quotes, trimmed, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit('"([^"]+)"'), F.lit(1)), lambda v: F.trim(v)))


def rule_ids(x: Column) -> Column:
    """R<n> named in a text, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"\bR(\d+)\b"), F.lit(1)), lambda n: F.concat(F.lit("R"), n)))


CRASH = r"Traceback \(most recent call last\)|SyntaxError|ModuleNotFoundError|command not found|No such file or directory|Permission denied"


def is_crash(x: Column) -> Column:
    return x.rlike(CRASH)


def json_array_in(x: Column, schema: str) -> Column:
    """The outermost JSON array in free text, parsed; null where there is none."""
    return F.from_json(F.nullif(F.regexp_extract(x, r"(?s)\[.*\]", 0), F.lit("")), schema)


def last_json_line(x: Column) -> Column:
    """The last line that is a JSON object, else the last 200 characters."""
    lines = F.filter(F.split(x, "\n"), lambda line: F.trim(line).rlike(r"\A\{.*\}\z") & F.json_object_keys(F.trim(line)).isNotNull())
    return F.when(F.size(lines) > 0, F.trim(F.element_at(lines, -1))).otherwise(F.right(x, F.lit(200)))


def key_digest(*parts: Column, size: int = 16) -> Column:
    """Content id: the first hex digits of the SHA-256 of the parts joined by colons; null is empty."""
    joined = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.substring(F.sha2(joined, 256), 1, size)


def text_digest(x: Column) -> Column:
    return F.sha2(collapse(x), 256)


def unquoted_prose(x: Column, quotes: bool = True) -> Column:
    """Own prose: without fenced and inline code, tags, addresses and paths, and (quotes) without quoted text."""
    out = x
    for pattern in (r"(?s)```.*?```", r"`[^`\n]*`", r"<[^<>\n]+>", r"https?://\S+", r"(?<!\S)[\w.-]*/[\w./-]+", *([r'"[^"\n]*"'] if quotes else [])):
        out = F.regexp_replace(out, pattern, " ")
    return out


def values_of(x: Column) -> Column:
    """One or many values as a clean list: trimmed, blanks dropped; null: empty."""
    return F.coalesce(F.filter(F.transform(x, lambda v: F.trim(v)), lambda v: v != ""), F.array().cast("array<string>"))


def folded(x: Column) -> Column:
    """A list as an order-free set of normal values, for comparison."""
    return F.array_sort(F.array_distinct(F.transform(x, norm)))


def message_text(blocks: Column) -> Column:
    """Text blocks (struct of type, text) joined by line ends."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")


def header(map_: Column, name: str) -> Column:
    """A map's value by name, in any case of letters."""
    return F.try_element_at(F.map_values(F.map_filter(map_, lambda k, _: F.lower(k) == name.lower())), F.lit(1))


def heredoc_targets(x: Column) -> Column:
    """Files that a shell text writes by here-documents, in order."""
    pattern = r"(?s)(?:>|>>|tee(?:\s+-a)?)\s*([^\s<>|;&]+)\s*<<-?\s*(['\"]?)(\w+)\2[^\n]*\n.*?\n\s*\3\s*(?:\n|\z)"
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(1))


def notebook_source(x: Column) -> Column:
    """The code cells of a notebook (JSON), one after another."""
    cells = F.from_json(x, "cells array<struct<cell_type: string, source: array<string>>>")["cells"]
    return F.array_join(F.transform(F.filter(cells, lambda c: c["cell_type"] == "code"), lambda c: F.array_join(c["source"], "")), "\n\n")


def sector(start: Column, end: Column, inner: Column, outer: Column) -> Column:
    """SVG path of a ring's sector between two shares of a turn, clockwise from the top."""
    point = lambda r, t: F.concat_ws(" ", *(F.format_string("%.2f", r * f(2 * F.pi() * t)) for f in (F.sin, lambda a: -F.cos(a))))
    large = F.when(end - start > 0.5, "1").otherwise("0")
    arc = lambda r, sweep, to: F.concat(F.lit("A "), F.format_string("%.2f %.2f 0 ", r, r), large, F.lit(f" {sweep} "), to)
    return F.concat_ws(" ", F.concat(F.lit("M "), point(outer, start)), arc(outer, 1, point(outer, end)), F.concat(F.lit("L "), point(inner, end)), arc(inner, 0, point(inner, start)), F.lit("Z"))
