"""Secret scans: base patterns, and a password guess-cost dynamic programme over values in credential contexts.

The guess cost of a value is the cheapest product of guesses over all ways of cutting it into dictionary words, dates,
repeats, sequences, keyboard walks and brute-force spans, found by one left-to-right pass. The dictionary is learnt from the texts
themselves: all words that stand in MIN_ROWS rows at least, credential values left out; a word's guesses are its rank, counted by classes of frequency. Only words that
some value may be made of are looked up, so only those are brought together: broadcast up to BROADCAST_BYTES, beyond that joined to the rows whose values ask for them. A
value that stands in a credential context and costs at least 10**MIN_LOG10 guesses is a secret, whatever its characters. A value of
letters alone counts only where a sign, a verb or "bearer" ties it to its context ("pin: ", "password is"), as any word may follow "key".

Null and empty texts give no spans. Very long texts are scanned whole, in time linear in them: contexts are found without their
values, and of a run of characters in which several contexts stand only the whole value and the last are priced, until the price
is high enough. Repeated rows each get their own row, and count once each for the dictionary.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import shared

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A word that announces a credential, a longer name that begins with it, what may stand between, and where the value begins.
CONTEXT = re.compile(
    r"""(?<![a-z0-9])(?:pass(?:word|wort|wd|phrase|code)?|kennwort|mot de passe|contrase(?:ñ|n)a|clave|pwd|pin|secrets?|tokens?|credentials?|auth(?:orization)?|bearer|login|(?:api|access|private|secret|signing|encryption)[_ -]?key|key)"""
    r"""(?P<name>(?:[_-][a-z]{1,20}(?![a-z0-9])){0,3})["'`\])]{0,2}[ \t]{0,4}(?P<tie>(?:(?::|=|=>|->|:=|\bis\b|\bwas\b)[ \t]{0,4}){0,2})(?:bearer |basic )?["'`(\[<]{0,2}""",
    re.I | re.A,
)
VALUE = re.compile(r"""[^\s"'`<>()\[\]{},;]*""")
HINTS = (b"pass", b"kennwort", b"contrase", b"clave", b"pwd", b"pin", b"secret", b"token", b"credential", b"auth", b"bearer", b"login", b"key")
MIN_LOG10 = 8.0
#: Addresses are no secrets.
ADDRESS = re.compile(r"[a-z][a-z0-9+.-]*://|www\.|[^@\s]+@[^@\s]+\.[^@\s]+\Z", re.I | re.A)
#: Frequent password words, most frequent first; the guesses for a word are its rank.
WORDS = (
    "password welcome monkey dragon master shadow sunshine princess football baseball letmein admin login secret token "
    "changeme default example sample test testing user guest root super hello love qwerty iloveyou charlie michael "
    "jordan ranger hunter tiger batman summer winter spring autumn flower orange purple cheese computer internet "
    "freedom whatever trustno starwars pass word your here none null true false value string placeholder insert my"
).split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
LEET = str.maketrans("@4301$5!7", "aaeoissit")
#: Letters of a dictionary word, and from how many rows at least it is learnt.
SHORTEST, LONGEST = 4, 24
MIN_ROWS = 3
#: Bytes of words that values ask for which are broadcast to the scan.
BROADCAST_BYTES = 16 << 20
LETTERS = re.compile(r"(?<![^\W_])[^\W\d_]{4,24}(?![^\W_])")
RUN = re.compile(r"[^\W\d_]{4,}")
#: log10 guesses of a date, of a year, of a sequence; of a repeat beside its character; of a walk, and of each of its keys.
DAY, YEAR, SEQUENCE, REPEAT, WALK, STEP = 4.5, 2.0, 2.0, 1.0, math.log10(4 * 12), 0.5


def neighbours() -> set[tuple[str, str]]:
    """Pairs of keys that touch on a keyboard, from its rows: beside each other, or one row down."""
    found = set()
    for r, row in enumerate(KEYBOARD):
        for i, key in enumerate(row):
            for other in (row[i + 1 : i + 2], *(KEYBOARD[r + 1][j : j + 1] for j in (i - 1, i) if r + 1 < len(KEYBOARD) and j >= 0)):
                if other:
                    found |= {(key, other), (other, key)}
    return found


NEAR = neighbours()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST_WORD = max(map(len, WORDS))


def word_cost(part: str, low: str, plain: str, words: dict[str, int]) -> float:
    """log10 guesses of a whole word as it is, in lower case, and with signs read as letters; infinite if it is none."""
    cost = math.inf
    if rank := RANK.get(plain):
        cost = math.log10(rank + 1) + (0.3 if part != low else 0) + (0.5 if plain != low else 0)
    if len(part) >= SHORTEST and (rank := words.get(low)) and part in (low, low.upper(), low.capitalize()):
        cost = min(cost, math.log10(rank + 1) + (0.3 if part != low else 0))
    return cost


def alphabet(value: str) -> float:
    """log10 guesses of one character of brute force."""
    return math.log10(max(10, sum(f for f, p in ((26, "[a-z]"), (26, "[A-Z]"), (10, "[0-9]"), (33, "[^a-zA-Z0-9]")) if re.search(p, value))))


def guess_cost(value: str, words: dict[str, int] | None = None, enough: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation needs (or any figure from `enough` on, once no continuation is cheaper). Empty: 0."""
    n, words = len(value), words or {}
    low = value.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = value
    plain = low.translate(LEET)
    brute = alphabet(value)
    dates: dict[int, list[int]] = {}  # beginnings by end
    best = [0.0] * (n + 1)
    run = walk = step = 0  # where the run of one character, the keyboard walk and the sequence began
    repeated = walked = counted = math.inf  # the cheapest beginning of each; of walks less STEP a character
    for e in range(1, n + 1):
        i = e - 1
        if value[i].isdigit() and (m := DATE.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
        if i:
            if value[i] != value[i - 1]:
                run, repeated = i, math.inf
            if (low[i - 1], low[i]) not in NEAR:
                walk, walked = i, math.inf
            d = ord(value[i]) - ord(value[i - 1])
            if abs(d) != 1:
                step, counted = i, math.inf
            elif i - step >= 2 and d != ord(value[i - 1]) - ord(value[i - 2]):
                step, counted = i - 1, math.inf
        cost = best[i] + brute
        if e - run >= 3:
            repeated = min(repeated, best[e - 3])
            cost = min(cost, repeated + brute + REPEAT)
        if e - walk >= 3:
            walked = min(walked, best[e - 3] - STEP * (e - 3))
            cost = min(cost, walked + WALK + STEP * e)
        if e - step >= 3:
            counted = min(counted, best[e - 3])
            cost = min(cost, counted + SEQUENCE)
        for s in dates.get(e, ()):
            cost = min(cost, best[s] + (DAY if e - s > 4 else YEAR))
        for s in range(max(0, e - LONGEST), e - 2):
            if e - s <= LONGEST_WORD or low[s:e] in words:
                cost = min(cost, best[s] + word_cost(value[s:e], low[s:e], plain[s:e], words))
        best[e] = cost
        if cost >= enough and min(best[max(0, e - LONGEST) : e]) >= enough and min(repeated, counted, walked + STEP * e) >= enough:
            return cost  # whatever follows begins at one of these
    return best[n]


def asked_by(value: str) -> set[str]:
    """The words that a segmentation of the value may hold."""
    return {r[i:j] for r in RUN.findall(value.lower()) for i in range(len(r) - SHORTEST + 1) for j in range(i + SHORTEST, min(len(r), i + LONGEST) + 1)}


def frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """word, n (rows of df in which it stands, values left out), asked (whether a value may be made of it), rank: how many words there are of its class of counts and
    of those above. Words are counted in each batch and summed by word; classes of small counts are single counts, and there are a few hundred of them."""
    shared.small_batches(df.sparkSession)

    def count(batches):
        import pyarrow as pa

        found: Counter = Counter()
        asked: set[str] = set()

        def sent():
            words = [*found, *(w for w in asked if w not in found)]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([found.get(w, 0) for w in words], pa.int64()), pa.array([w in asked for w in words], pa.bool_())], names=["word", "n", "asked"])
            found.clear()
            asked.clear()
            return out

        for batch in batches:
            for raw, t in zip(shared.as_bytes(batch.column(0)), batch.column(0).to_pylist(), strict=True):
                if t:
                    raw = raw.lower()
                    if any(h in raw for h in HINTS):
                        for _, _, value in candidates(t, raw):
                            asked |= asked_by(value)
                        t = "".join(blanked(t, raw))
                    found.update(set(LETTERS.findall(t.lower())))
                if len(found) + len(asked) > 200_000:
                    yield sent()
        yield sent()
        shared.release()

    counted = df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word string, n long, asked boolean")
    kind = F.floor(F.log2("n") * 16).alias("kind")
    counted, _ = shared.stored(counted.groupBy("word").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")).where(F.col("n") >= MIN_ROWS).select("word", "n", "asked", kind), "words")
    classes = counted.groupBy("kind").agg(F.count("*").alias("many"))
    upto = classes.select("kind", F.sum("many").over(Window.orderBy(F.desc("kind"))).alias("rank"))
    return counted.join(F.broadcast(upto), "kind").drop("kind")


def dictionary(df: DataFrame, text: str = "text", size: int = 100_000) -> dict[str, int]:
    """The `size` words of the most rows with their rank, for a caller who keeps a dictionary; `scan` needs no such bound."""
    return {r["word"]: r["rank"] for r in frequencies(df, text).orderBy(F.desc("n"), "word").limit(size).collect()}


def asked_words(df: DataFrame, text: str = "text") -> DataFrame:
    """word, rank of all learnt words that a value of df may be made of."""
    return shared.stored(frequencies(df, text).where("asked").select("word", F.col("rank").cast("int").alias("rank")), "asked")[0]


OWN = "_quern_words"


def with_words(df: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """df with the words that each row's values ask for, as a map (null: none); rows are found again by the hash of their text."""
    def rows(batch):
        out: dict = {"mark": [], "word": []}
        for mark, raw, t in zip(batch.column(0).to_pylist(), shared.as_bytes(batch.column(1)), batch.column(1).to_pylist(), strict=True):
            raw = raw.lower()
            if t and any(h in raw for h in HINTS):
                asked = set().union(*(asked_by(v) for _, _, v in candidates(t, raw)))
                out["mark"] += [mark] * len(asked)
                out["word"] += asked
        return out

    pairs = shared.arrow_map(df.select(shared.mark(text).alias("mark"), F.col(text).cast("string")), rows, "mark long, word string").distinct()
    own = pairs.join(words, "word").groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("word", "rank"))).alias(OWN))
    return df.withColumn("_quern_mark", shared.mark(text)).join(own.withColumnRenamed("mark", "_quern_mark"), "_quern_mark", "left").drop("_quern_mark")


def prepared(df: DataFrame, text: str, words: dict[str, int] | None) -> tuple[DataFrame, object]:
    """df, with its words beside each row where they are too many to broadcast; and the broadcast words."""
    spark = df.sparkSession
    if words is None:
        asked = asked_words(df, text)
        if (asked.agg(F.sum(F.octet_length("word") + 60)).first()[0] or 0) > BROADCAST_BYTES:
            return with_words(df, text, asked), spark.sparkContext.broadcast({})
        words = {r["word"]: r["rank"] for r in asked.collect()}
    return df, spark.sparkContext.broadcast(words)


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns; raw is the lower-cased UTF-8 text, for a quick look."""
    found = []
    if b"pass" in raw or b"secret" in raw or b"token" in raw or b"api" in raw:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"akia" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def values(text: str, raw: bytes) -> list[tuple[int, int, bool]]:
    """(start, end, tied) of the values in credential contexts: in each run of characters the first and the last. tied: a sign or verb stands before."""
    found: list[tuple[int, int, bool]] = []
    if any(h in raw for h in HINTS):
        stop, many = -1, 0
        for m in CONTEXT.finditer(text):
            starts = [(m.end(), bool(m["tie"]) or "bearer" in m[0].lower())]
            if m["name"] and not m["tie"]:
                starts.insert(0, (m.start("name") + 1, False))  # what looks like a longer name may be the value
            for start, tied in starts:
                if start > stop:
                    stop, many = VALUE.match(text, start).end(), 0
                if stop - start >= 6:
                    if many > 1:
                        found.pop()
                    found.append((start, stop, tied))
                    many += 1
    return found


def blanked(text: str, raw: bytes):
    """The text in pieces, without the values."""
    at = 0
    for start, stop, _ in values(text, raw):
        if start >= at:
            yield text[at:start]
        at = max(at, stop)
    yield text[at:]


def candidates(text: str, raw: bytes):
    """(start, whether it is tied to its context, value) of the values that are priced."""
    for start, stop, tied in values(text, raw):
        value = text[start:stop].rstrip(".:!?")
        if len(value) >= 6 and not ADDRESS.match(value) and (tied or not value.isalpha()):
            yield start, tied, value


def guessed_spans(text: str, raw: bytes, words: dict[str, int] | None = None, least: float = MIN_LOG10) -> list[tuple[int, int, int]]:
    found: list[tuple[int, int, int]] = []
    for start, _, value in candidates(text, raw):
        if not (found and start < found[-1][2]) and guess_cost(value, words, least) >= least:
            found.append((start, 3, start + len(value)))
    return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(df: DataFrame, text: str = "text", id_column: str = "doc_id", words: dict[str, int] | None = None) -> DataFrame:
    """One row per row of df: id, n_assign, n_access, n_hex, base (its spans), spans (all). words: a dictionary; else df's own is learnt first."""
    spark = df.sparkSession
    shared.small_batches(spark)
    kind = dict(df.dtypes)[id_column]
    df, told = prepared(df, text, words)
    beside = OWN in df.columns

    def rows(batch):
        raws, texts = shared.as_bytes(batch.column(1)), batch.column(1).to_pylist()
        owns = batch.column(2).to_pylist() if beside else [None] * len(texts)
        out = {"doc_id": batch.column(0), "n_assign": [], "n_access": [], "n_hex": [], "base": [], "spans": []}
        for raw, t, own in zip(raws, texts, owns, strict=True):
            raw, t = raw.lower(), t or ""
            base = base_spans(t, raw)
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(s[1] == k for s in base))
            out["base"].append(listed(base))
            out["spans"].append(listed(base + guessed_spans(t, raw, dict(own) if own else told.value)))
        return out

    return shared.arrow_map(df.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string"), *([OWN] if beside else [])), rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")


MASK = "[SECRET]"


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for s, _, e in sorted(spans):
        if e > at:
            if s >= at:
                out += [text[at:s], MASK]
            at = e
    return "".join(out) + text[at:]


def redact(df: DataFrame, words: dict[str, int] | None = None) -> DataFrame:
    """The rows of documents with each secret span replaced by MASK and n_chars brought up to date; texts without spans and null texts stay as they are."""
    spark = df.sparkSession
    shared.small_batches(spark)
    names, schema = df.columns, df.schema
    df, told = prepared(df, "text", words)
    beside, df = OWN in df.columns, df.select(*names, *([OWN] if OWN in df.columns else []))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = names.index("text")
            raws, texts = shared.as_bytes(batch.column(at)), batch.column(at).to_pylist()
            owns = batch.column(len(names)).to_pylist() if beside else [None] * len(texts)
            for i, (raw, t, own) in enumerate(zip(raws, texts, owns, strict=True)):
                if t:
                    raw = raw.lower()
                    if spans := base_spans(t, raw) + guessed_spans(t, raw, dict(own) if own else told.value):
                        texts[i] = redact_text(t, spans)
            columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        shared.release()

    out = df.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)).select(*names) if "n_chars" in names else out


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def brute_force_base(text: str | None) -> str:
    """The base contract by the plain expressions, for tests."""
    text, spans = text or "", []
    spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return hashlib.sha256(listed(spans).encode()).hexdigest()


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLES: dict[str, str] = {}
