"""Rule checks over replies and files: a null verdict means that the check could not be made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import filters

#: English words that give an English sentence away, where another language is asked for.
ENGLISH = ("the", "and", "with", "this", "that", "from", "have", "will", "your", "should")


def quoted(token: str) -> str:
    return r"\Q" + token.replace(r"\E", r"\E\\E\Q") + r"\E"


def starts_with(reply: Column, token: str) -> Column:
    return reply.rlike(rf"\A\s*{quoted(token)}")


def ends_with(reply: Column, token: str) -> Column:
    return reply.rlike(rf"{quoted(token)}\s*\z")


def avoids(reply: Column, words: tuple[str, ...], but: tuple[str, ...] = ()) -> Column:
    """No forbidden word stands in own prose; allowed compounds are taken out first."""
    prose = F.lower(text.unquoted_prose(reply))
    for b in but:
        prose = F.replace(prose, F.lit(b.lower()), F.lit(" "))
    return ~prose.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(map(quoted, (w.lower() for w in words))) + r")(?![\p{L}\p{N}])")


def in_chinese(reply: Column) -> Column:
    """Holds Han, no run of six Latin words, none of the listed English words."""
    return reply.rlike(r"\p{IsHan}") & ~reply.rlike(r"(?:\b[A-Za-z']+\b[ ,]+){5}\b[A-Za-z']+\b") & ~F.lower(reply).rlike(r"\b(?:" + "|".join(ENGLISH) + r")\b")


def declares(path: Column, content: Column, declaration: str) -> Column:
    """The first line holds the declaration in the file's own comment form; null if the kind has none."""
    form = filters.comment_form(path)
    line = F.trim(text.first_line(content))
    return F.when(form.isNotNull(), F.startswith(line, form) & F.contains(line, F.lit(declaration)))


def describes(path: Column, content: Column, declaration: str) -> Column:
    """One of the first three lines is a comment of at least four words that is not the declaration."""
    form = filters.comment_form(path)
    lines = F.slice(F.split(content, "\n"), 1, 3)
    good = lambda line: F.startswith(F.trim(line), form) & ~F.contains(line, F.lit(declaration)) & (text.n_words(line) >= 5)
    return F.when(form.isNotNull(), F.exists(lines, good))


def edited(content: Column, edits: Column) -> Column:
    """The text after edits (array of old, new, every); null as soon as an old part is missing."""

    def one(t: Column, e: Column) -> Column:
        at = F.instr(t, e["old"])
        once = F.concat(F.substring(t, F.lit(1), at - 1), e["new"], F.substring(t, at + F.length(e["old"]), F.length(t)))
        return F.when(at > 0, F.when(e["every"], F.replace(t, e["old"], e["new"])).otherwise(once))

    return F.aggregate(edits, content, one)
