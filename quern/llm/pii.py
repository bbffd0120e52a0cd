"""Information-theoretic sanitisation, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, cards and phone numbers; their values are the protected entities. Over
the whole corpus, the terms beside an entity's mentions estimate how strongly a term reveals it: with document
frequencies, PMI(e; t) = log2(N df(e, t) / (df(e) df(t))) against IC(e) = log2(N / df(e)), where df(e, t) counts the documents in which t
stands beside any mention of e. A term whose PMI is at least GENERALISE of the entity's information, seen beside it in at least CONTEXTS
different surroundings, in one document or in many (so that copies of one text don't count), is disclosing: each of its occurrences, in any document, becomes a span. `sanitised` puts a class in its place, or
removes it from REMOVE on.

Positions come from cutting a text at its matches: what lies between them and the matches themselves add up. Expressions begin
only where a run of their characters begins and never go back, so each is linear in the text.

Null and empty texts have no spans. A text of only matches, and texts of thousands of them, are added up in two levels. Repeated
rows each get a row. Rows with a null doc_id get base spans, but take no part in counts and have no terms.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import shared

KINDS = ("email", "ip", "card", "phone", "term")
#: Java expressions; equal to the contract's, with starts bound to where a run begins and possessive repeats.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Characters of surroundings on either side, and what parts terms there and in texts (one character each).
AROUND = 80
PART = r"[^\p{L}\p{N}]"
SHORTEST = 3
CONTEXTS = 3
GENERALISE, REMOVE = 0.8, 0.95
#: Bytes of terms that are broadcast to the scan of texts; more are joined by sorting.
BROADCAST_BYTES = 16 << 20
BLOCK = 256


def running(lengths: Column) -> Column:
    """Exclusive running sums of an array of ints, in two levels so that long arrays cost in proportion."""
    empty = F.array().cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))

    def block(s: Column, lens: Column) -> Column:
        return F.aggregate(lens, F.struct(s["at"].alias("at"), empty.alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda r: F.struct(r["at"].alias("at"), F.array_append(s["out"], r["out"]).alias("out")))

    return F.when(F.size(lengths) > 0, F.flatten(F.aggregate(blocks, start, block, lambda s: s["out"]))).otherwise(empty)


def luhn(digits: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(digits))
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(at, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def fits(kind: int, m: Column) -> Column:
    if kind == 1:
        return m.rlike(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z")
    if kind == 2:
        digits = F.regexp_replace(m, r"[\x20-]", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == 3:
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def spans_of(kind: int, text: Column) -> tuple[Column, Callable]:
    """The matches and what lies between them; and what makes (start, kind, end, value, context) of them and their running lengths."""
    pattern = F.lit(PATTERNS[kind])
    worth = (F.contains(text, F.lit("@")), text.rlike(r"[0-9]\.[0-9]"), text.rlike("[0-9](?:[ -]?[0-9]){11}"), text.rlike(r"\+[0-9]"))[kind]
    found = F.when(worth, F.regexp_extract_all(text, pattern, F.lit(0)))
    between = F.when(worth, F.split(text, PATTERNS[kind], -1))
    lengths = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.length(m) + F.length(b))

    def spans(found: Column, between: Column, before: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            left, right = F.element_at(between, i + 1), F.element_at(between, i + 2)
            start = F.element_at(before, i + 1) + F.length(left)
            # a word that the bound cuts goes
            ahead = F.when(F.length(left) > AROUND, F.regexp_replace(F.right(left, F.lit(AROUND)), rf"\A[\p{{L}}\p{{N}}]{{0,{AROUND}}}", "")).otherwise(left)
            behind = F.when(F.length(right) > AROUND, F.regexp_replace(F.left(right, F.lit(AROUND)), rf"[\p{{L}}\p{{N}}]{{0,{AROUND}}}\z", "")).otherwise(right)
            around = F.concat(ahead, F.lit(" "), behind)
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), F.lower(m).alias("value"), around.alias("context"))

        return F.filter(F.transform(found, one), lambda s: fits(kind, s["value"]))

    return F.struct(found.alias("found"), between.alias("between"), lengths.alias("lengths")), spans


EMPTY = "array<struct<start int, kind int, end int, value string, context string>>"


def mark() -> Column:
    return F.xxhash64(F.col("text").cast("string")).alias("mark")


def base(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text) and all base spans, by start and kind."""
    out = docs.select("doc_id", mark(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    makers = []
    for k in range(len(PATTERNS)):
        parts, make = spans_of(k, F.col("text"))
        makers.append(make)
        out = out.withColumn(f"m{k}", parts)
    out = out.drop("text")
    for k in range(len(PATTERNS)):
        out = out.withColumn(f"b{k}", F.when(F.size(f"m{k}.found") > 0, running(F.col(f"m{k}.lengths"))))
    for k, make in enumerate(makers):
        made = make(F.col(f"m{k}.found"), F.col(f"m{k}.between"), F.col(f"b{k}"))
        out = out.withColumn(f"s{k}", F.when(F.size(f"m{k}.found") > 0, made).otherwise(F.array().cast(EMPTY)))
    return out.select("doc_id", "mark", F.array_sort(F.concat(*(F.col(f"s{k}") for k in range(len(PATTERNS))))).alias("spans"))


def terms_of(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), PART)), lambda t: F.length(t) >= SHORTEST)


def few(df: DataFrame, size: Column) -> DataFrame:
    """df, to be broadcast where its bytes (size: of a row) allow."""
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long") + 32)).first()[0] or 0) <= BROADCAST_BYTES else df


def counted(rows: DataFrame, column: str, name: str, keys: list[str]) -> DataFrame:
    """How many distinct values of a column each group has: by value first, then by group, so that a hot group doesn't meet in one task."""
    return rows.select(*keys, column).distinct().groupBy(*keys).agg(F.count("*").alias(name))


def disclosing(docs: DataFrame, found: DataFrame, contexts: int = CONTEXTS, least: float = GENERALISE) -> DataFrame | None:
    """term and strength: the largest PMI(e; t) / IC(e) over entities. None if no term was seen in enough surroundings."""
    mentions = found.where("doc_id IS NOT NULL").select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.concat_ws(":", F.col("s.kind").cast("string"), F.col("s.value")).alias("entity"), F.col("s.context").alias("context"))
    mentions, _ = shared.stored(mentions.distinct(), "mentions")
    seen = counted(mentions.withColumn("at", F.xxhash64("context")), "at", "seen", ["entity"]).where(F.col("seen") >= contexts)
    entities = counted(mentions, "doc_id", "df_e", ["entity"]).join(seen, "entity").select("entity", "df_e")
    pairs = mentions.join(entities.select("entity"), "entity", "left_semi").select("entity", "doc_id", F.xxhash64("context").alias("at"), F.explode(terms_of(F.col("context"))).alias("term")).where(~F.col("term").rlike("^[0-9]+$"))
    both = ["entity", "term"]
    around = counted(pairs, "at", "contexts", both).where(F.col("contexts") >= contexts)
    pairs = counted(pairs, "doc_id", "df_et", both).join(around, both).join(entities, "entity")
    pairs, _ = shared.stored(pairs, "pairs")
    if pairs.isEmpty():
        return None
    wanted = few(pairs.select("term").distinct(), F.octet_length("term"))
    # counted before the join, so that one row a term reaches it, however common; a semi join would be pushed below the count
    counts = docs.where("doc_id IS NOT NULL").select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df_t")).join(wanted, "term")
    total = docs.where("doc_id IS NOT NULL").count()
    ic = F.log2(F.lit(float(total)) / F.col("df_e"))
    pmi = F.log2(F.lit(float(total)) * F.least("df_et", "df_t") / (F.col("df_e") * F.col("df_t")))
    strength = F.when(ic > 0, pmi / ic).otherwise(0.0)
    out, _ = shared.stored(pairs.join(counts, "term").groupBy("term").agg(F.max(strength).alias("strength")).where(F.col("strength") >= least), "terms")
    return out


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, mark, terms: (start, kind, end, strength) of all occurrences of the terms in any document."""
    terms = few(terms, F.octet_length("term"))
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", mark(), F.col("text").cast("string").alias("text"))
    have = docs.select("doc_id", "mark", F.explode(terms_of(F.col("text"))).alias("term")).join(terms, "term").groupBy("doc_id", "mark").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("term", "strength")))).alias("own"))
    have, _ = shared.stored(have, "holders")
    cut = docs.join(few(have, F.aggregate(F.map_keys("own"), F.lit(0), lambda a, t: a + F.octet_length(t) + 32)), ["doc_id", "mark"]).select("doc_id", "mark", "own", F.split("text", PART, -1).alias("words"))
    cut = cut.withColumn("before", running(F.transform("words", lambda w: F.length(w) + 1)))
    each = F.zip_with("words", "before", lambda w, b: F.struct(b.alias("start"), F.lit(4).alias("kind"), (b + F.length(w)).alias("end"), F.try_element_at("own", F.lower(w)).alias("strength")))
    return cut.select("doc_id", "mark", F.filter(each, lambda s: s["strength"].isNotNull()).alias("terms")).dropDuplicates(["doc_id", "mark"])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, mark, base (array of start, kind, end), terms (array of start, kind, end, strength; null if none)."""
    found, _ = shared.stored(base(docs), "base")
    terms = disclosing(docs, found)
    plain = found.select("doc_id", "mark", F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["end"])).alias("base"))
    if terms is None or terms.isEmpty():
        return plain.withColumn("terms", F.lit(None).cast("array<struct<start int, kind int, end int, strength double>>"))
    return plain.join(term_spans(docs, terms), ["doc_id", "mark"], "left")


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id, text: base spans and disclosing terms replaced by their class; terms of at least REMOVE removed; overlaps by the first. Rows need a doc_id."""
    found = scan(docs).where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "mark"])
    label = lambda s: F.when(s["strength"] >= REMOVE, "").otherwise(F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]")))
    full = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(None).cast("double").alias("strength")))
    every = F.array_sort(F.concat(full, F.coalesce("terms", F.array().cast("array<struct<start int, kind int, end int, strength double>>"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.col("text").substr(a["at"] + 1, s["start"] - a["at"]), label(s)).alias("out")))
    empty = F.array().cast("array<struct<start int, kind int, end int>>")
    both = docs.select("doc_id", mark(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(found, ["doc_id", "mark"], "left").withColumn("base", F.coalesce("base", empty)).withColumn("every", every)
    made = both.withColumn("made", F.aggregate("every", begin, step))
    return made.select("doc_id", F.concat("made.out", F.col("text").substr(F.col("made.at") + 1, F.length("text"))).alias("text"))


def op1_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(shared.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    terms = F.coalesce(F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))), F.array().cast("array<struct<start int, kind int, end int>>"))
    every = F.array_sort(F.concat("base", terms))
    return found.select("doc_id", *(count(k) for k in range(4)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"))


def brute_force_base(text: str | None) -> list[tuple[int, int, int]]:
    """The base contract by its plain expressions, for tests: (start, kind, end)."""
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c not in " -"]
        if 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def brute_force_sha(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in brute_force_base(text)).encode()).hexdigest()


def brute_force_terms(rows: list[tuple[int | None, str | None]], contexts: int = CONTEXTS, least: float = GENERALISE) -> dict[str, float]:
    """Disclosing terms and their strength, mention by mention, for tests."""
    seen: dict[tuple[str, str], set] = {}
    held: dict[str, set[int]] = {}
    words: dict[str, set[int]] = {}
    surroundings: dict[str, set[str]] = {}
    parted = lambda t: {w for w in re.split(r"[^\w]|_", t.lower()) if len(w) >= SHORTEST}
    n = sum(1 for d, _ in rows if d is not None)
    for d, text in rows:
        if d is None:
            continue
        for w in parted(text or ""):
            words.setdefault(w, set()).add(d)
        base = brute_force_base(text)
        every = [sorted(m.span() for m in re.finditer(p, text or "")) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]
        for start, kind, end in base:
            before = max((e for _, e in every[kind] if e <= start), default=0)
            after = min((s for s, _ in every[kind] if s >= end), default=len(text))
            left, right = text[before:start], text[end:after]
            left = re.sub(rf"\A[^\W_]{{0,{AROUND}}}", "", left[-AROUND:]) if len(left) > AROUND else left
            right = re.sub(rf"[^\W_]{{0,{AROUND}}}\Z", "", right[:AROUND]) if len(right) > AROUND else right
            around = f"{left} {right}"
            entity = f"{kind}:{text[start:end].lower()}"
            held.setdefault(entity, set()).add(d)
            surroundings.setdefault(entity, set()).add(around)
            for t in parted(around):
                if not t.isdigit():
                    seen.setdefault((entity, t), set()).add((d, around))
    out: dict[str, float] = {}
    for (e, t), found in seen.items():
        if len({a for _, a in found}) < contexts or len(surroundings[e]) < contexts:
            continue
        ic = math.log2(n / len(held[e]))
        strength = math.log2(n * min(len({d for d, _ in found}), len(words[t])) / (len(held[e]) * len(words[t]))) / ic if ic > 0 else 0.0
        if strength >= least:
            out[t] = max(out.get(t, 0.0), strength)
    return out


QUERIES = {"op1_sanitise": op1_sanitise}
ORACLES: dict[str, str] = {}
