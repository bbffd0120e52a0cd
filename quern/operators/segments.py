"""Relational segmentation: the parts of the grammar that need no state, as expressions over whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text

#: Marks a boundary; removed by the split.
CUT = "\x01"


def line_parts() -> Column:
    """First grammar's prose rule: every line end and each of . ! ? ; before white space ends a unit."""
    return kept(F.split(F.regexp_replace(F.regexp_replace("text", r"([.!?;])(?=\s)", "$1" + CUT), "\n", CUT), CUT))


def sentence_parts() -> Column:
    """Second grammar's restricted rule: sentence ends before white space and blank lines; a plain line end is none."""
    return kept(F.split(F.regexp_replace(F.regexp_replace("text", r"([.!?]+)\s+", "$1" + CUT), r"\n[ \t]*\n", CUT), CUT))


def kept(parts: Column) -> Column:
    """Trimmed parts that hold enough letters or digits."""
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)\A\s+|\s+\z", "")), text.worth_keeping)


def lines_and_terminals(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Units of the first grammar: key, idx, text."""
    return units(docs, line_parts(), key)


def sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Units of the second grammar: key, idx, text."""
    return units(docs, sentence_parts(), key)


def units(docs: DataFrame, parts: Column, key: str) -> DataFrame:
    """Numbered parts; numbering inside the row, so no shuffle."""
    return docs.select(key, F.posexplode(parts).alias("pos", "text")).select(key, (F.col("pos") + 1).alias("idx"), "text")


def compared(docs: DataFrame) -> DataFrame:
    """For both grammars: units, breaks inside a sentence, fragments of at most three words. A unit gets the next one from its row's
    array, so that no text is shuffled and only sums are."""

    def cut(name: str, parts: Column) -> DataFrame:
        beside = F.transform("parts", lambda u, i: F.struct(u.alias("text"), F.get("parts", i + 1).alias("after")))
        return docs.select(parts.alias("parts")).select(F.lit(name).alias("grammar"), F.explode(beside).alias("u")).select("grammar", "u.*")

    broken = ~F.col("text").rlike("[.!?;:]\\z") & F.coalesce(F.col("after").rlike(r"\A[a-z]"), F.lit(False))
    both = cut("lines", line_parts()).unionByName(cut("sentences", sentence_parts()))
    return both.groupBy("grammar").agg(F.count("*").alias("units"), F.sum(broken.cast("long")).alias("mid_breaks"), F.sum((text.n_words(F.col("text")) <= 3).cast("long")).alias("fragments"))


def wordings(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each wording (white space aside) with its rows and documents. Digests travel as 32 bytes, not as text."""
    found = pieces.groupBy(F.unhex(text.text_digest(F.col("text"))).alias("sha")).agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_docs"), F.min("text").alias("example"))
    return found.select(F.lower(F.hex("sha")).alias("text_sha256"), "n_rows", "n_docs", "example")


def duplicate_counts(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, idx, text_sha256, n_dup_text: how often a unit's wording occurs, carried on the unit.

    Counted first with partial sums, so a frequent wording is not one window; only wordings that repeat are joined back, mostly few
    enough to be broadcast once their size is known, and a frequent one is split by the skew join otherwise.
    """
    named = pieces.select(key, "idx", F.unhex(text.text_digest(F.col("text"))).alias("sha"))
    repeated = named.groupBy("sha").agg(F.count("*").alias("n")).where("n > 1")
    return named.join(repeated, "sha", "left").select(key, "idx", F.lower(F.hex("sha")).alias("text_sha256"), F.coalesce("n", F.lit(1)).cast("long").alias("n_dup_text"))


def contexts(docs: DataFrame, key: str = "doc_id", before: int = 8, after: int = 2) -> DataFrame:
    """Each line with the lines around it, in one pass over a row's own array, of which a line takes only its part along: key, line, first, last, context."""

    def around(_: Column, pos: Column) -> Column:
        first, last = F.greatest(F.lit(0), pos - before), F.least(F.size("lines") - 1, pos + after)
        return F.struct((pos + 1).alias("line"), (first + 1).alias("first"), (last + 1).alias("last"), F.array_join(F.slice("lines", first + 1, last - first + 1), "\n").alias("context"))

    return docs.select(key, F.split("text", "\n").alias("lines")).select(key, F.explode(F.transform("lines", around)).alias("at")).select(key, "at.*")


def fence_parity(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with whether an odd number of fence marks stands at or above them: key, line, fenced."""
    at = docs.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "own")).withColumn("mark", F.col("own").rlike(r"\A\s*(```|~~~)").cast("int"))
    above = F.sum("mark").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return at.select(key, (F.col("pos") + 1).alias("line"), ((above % 2 == 1) | (F.col("mark") == 1)).alias("fenced"))


#: Levels of headings in a document.
LEVELS = 6


def breadcrumbs(offsets: DataFrame, headings: DataFrame) -> DataFrame:
    """As-of join with a stack: offsets (doc, off) with the titles of the headings that enclose them.

    headings: doc, pos, level (1 to LEVELS), title. A heading encloses an offset if it comes at or before it and no later heading,
    still at or before it, has the same or a higher rank. One sorted stream a document: beside each offset stand the last heading
    of each level, and those hold that come after the last of every higher rank.
    """
    stream = headings.select("doc", F.col("pos").alias("off"), "level", "title", F.lit(0).alias("_kind"))
    stream = stream.unionByName(offsets.select("doc", "off", F.lit(None).cast(headings.schema["level"].dataType).alias("level"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("_kind")))
    w = Window.partitionBy("doc").orderBy("off", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = {n: F.last(F.when(F.col("level") == n, F.struct(F.col("off").alias("pos"), "title")), ignorenulls=True).over(w) for n in range(1, LEVELS + 1)}
    at = stream.select("doc", "off", "_kind", *(c.alias(f"_h{n}") for n, c in last.items())).where("_kind = 1")

    def holds(n: int) -> Column:
        higher = [F.coalesce(F.col(f"_h{k}.pos"), F.lit(-1)) for k in range(1, n)]
        return F.col(f"_h{n}").isNotNull() & (F.col(f"_h{n}.pos") > (F.greatest(*higher) if n > 2 else higher[0] if higher else F.lit(-1)))

    titles = F.array(*(F.when(holds(n), F.col(f"_h{n}.title")) for n in range(1, LEVELS + 1)))
    return at.select("doc", "off", F.array_join(titles, " > ").alias("path"))


def line_of(content, offset):
    """1-based line that holds a code-point offset."""
    return F.size(F.split(F.substring(content, F.lit(1), offset), "\n"))
