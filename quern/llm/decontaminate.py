"""Benchmark decontamination: one Aho-Corasick automaton over the normalised words of test items, run once over each text.

Words are maximal runs outside ASCII punctuation and spaces, A-Z lower-cased; the automaton runs over word numbers, so
a match ends at a word. Normalising keeps every byte's place, so the words of a match lead back to code points of the original
text (column offsets). A window is 13 words of an item, or the whole item where it has fewer. No shuffle: documents are mapped
where they are read.

Null and empty texts have no words and are never contaminated; items without words have no window. Items that repeat
share windows and all count; rows of one item id are one item. Windows of items without an id hit, but name no item. Repeated
documents each get their row. Very long texts are scanned whole. Extra columns of either table are not read.

The automaton holds the benchmark, which is bounded: PART_BYTES bytes an automaton, built once in each Python worker, by the digest of its items (some 9 s
and 160 MB for 1 MB of benchmark). A larger benchmark is cut into parts by item, which the driver reads, sends, has scanned and frees one after the
other, and hits are joined by row; results are the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import shared

WINDOW = 13
PART_BYTES = 2 << 20
#: Bytes to their normal form: A-Z to a-z, digits, a-z and all of non-ASCII as they are, the rest to a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


def offsets_of(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words (in order, apart) as spans of code points of the text, end exclusive."""
    if not spans:
        return []
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(NORMAL))]
    out, at, code = [], 0, 0
    for first, end in spans:
        start, stop = places[first][0], places[end - 1][1]
        code += len(raw[at:start].decode())
        size = len(raw[start:stop].decode())
        out.append((code, code + size))
        code, at = code + size, stop
    return out


def windows(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))} if words else set()


class Matcher:
    """The automaton over word numbers."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]) -> None:
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, words in items:
            for w in windows(words):
                named = owners.setdefault(tuple(self.numbers.setdefault(x, len(self.numbers) + 1) for x in w), set())
                if name is not None:
                    named.add(name)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in owners.items():
            self.automaton.add_word(key, (len(key), names))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Covered spans of words (first, end), merged and in order, and the names of items found."""
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        if self.empty or not words:
            return spans, names
        numbers = tuple(map(self.numbers.get, words, repeat(0)))
        if not any(numbers):
            return spans, names
        for end, (size, owners) in self.automaton.iter(numbers):
            names |= owners
            first = end + 1 - size
            while spans and spans[-1][1] >= first:
                first = min(first, spans.pop()[0])
            spans.append((first, end + 1))
        return spans, names


def parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items by parts of about part_bytes, dealt by a hash; one part at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // part_bytes) + 1
    for i in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r["item_id"], words_of((r["text"] or "").encode())) for r in own.collect()]


#: A worker's last automaton, by the digest of its items: later tasks find it there.
MATCHERS: dict[str, Matcher] = {}


def matcher_for(spark: SparkSession, items: list):
    """What gives a worker its automaton; and the broadcast items, to be freed."""
    sent, digest = spark.sparkContext.broadcast(items), hashlib.sha256(repr(items).encode()).hexdigest()

    def get() -> Matcher:
        from quern.llm import decontaminate  # the worker's module, not a copy of this one's names sent with the task

        if digest not in decontaminate.MATCHERS:
            decontaminate.MATCHERS.clear()
            decontaminate.MATCHERS[digest] = decontaminate.Matcher(sent.value)
        return decontaminate.MATCHERS[digest]

    return get, sent


FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<first: int, end: int>>, offsets array<struct<start: int, end: int>>"


def matched(docs: DataFrame, get) -> DataFrame:
    """All columns but text as they are, and what one automaton finds: n_words, n_hit, items, spans (of words), offsets (of code points)."""
    columns = docs.columns
    keys, at = [c for c in columns if c != "text"], columns.index("text")

    def rows(batch):
        match = get()
        out = {c: batch.column(i) for i, c in enumerate(columns) if i != at} | {c: [] for c in ("n_words", "n_hit", "items", "spans", "offsets")}
        for raw in shared.as_bytes(batch.column(at)):
            words = words_of(raw)
            spans, names = match.hits(words)
            out["n_words"].append(len(words))
            out["n_hit"].append(sum(e - s for s, e in spans))
            out["items"].append(sorted(names))
            out["spans"].append([{"first": s, "end": e} for s, e in spans])
            out["offsets"].append([{"start": s, "end": e} for s, e in offsets_of(raw, spans)])
        return out

    kinds = dict(docs.dtypes)
    return shared.arrow_map(docs, rows, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", " + FOUND)


#: Spans of several parts, sorted, as the maximal spans they cover.
MERGED = """aggregate(array_sort(flatten(collect_list({0}))), cast(array() as array<struct<{1}: int, end: int>>),
(acc, x) -> if(size(acc) > 0 and element_at(acc, -1).end >= x.{1},
concat(slice(acc, 1, size(acc) - 1), array(named_struct('{1}', element_at(acc, -1).{1}, 'end', greatest(element_at(acc, -1).end, x.end)))), concat(acc, array(x))))"""


def scan(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: keys, n_words, n_hit, n_items, items (sorted), spans (first, end of hit words), offsets (start, end of hit code points)."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    cut = parts(benchmark, part_bytes)
    own, following = next(cut), next(cut, None)
    docs = docs.select(*keys, F.col("text").cast("string").alias("text"))
    if following is None:
        return matched(docs, matcher_for(spark, own)[0]).withColumn("n_items", F.size("items").cast("long"))
    numbered, _ = shared.stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = None
    while own is not None:
        get, sent = matcher_for(spark, own)
        one, _ = shared.stored(matched(numbered, get), "part")
        sent.destroy()
        found = one if found is None else found.unionByName(one)
        own, following = following, next(cut, None)
    # words that touch are one span of words, but between their code points there may be signs: spans are merged by words
    merged = found.groupBy("_row").agg(*(F.first(k).alias(k) for k in keys), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.expr(MERGED.format("spans", "first")).alias("spans"))
    merged = merged.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"]))
    placed = numbered.select("_row", "text").join(merged.where("n_hit > 0").select("_row", "spans"), "_row")

    def rows(batch):
        spans = [[(x["first"], x["end"]) for x in own] for own in batch.column(2).to_pylist()]
        return {"_row": batch.column(0), "offsets": [[{"start": s, "end": e} for s, e in offsets_of(raw, own)] for raw, own in zip(shared.as_bytes(batch.column(1)), spans, strict=True)]}

    offsets = shared.arrow_map(placed.select("_row", "text", "spans"), rows, "_row long, offsets array<struct<start: int, end: int>>")
    out = merged.join(offsets, "_row", "left").withColumn("offsets", F.coalesce("offsets", F.expr("cast(array() as array<struct<start: int, end: int>>)")))
    return out.select(*keys, "n_words", "n_hit", "items", "spans", "offsets", F.size("items").cast("long").alias("n_items"))


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """documents without the contaminated ones: one automaton judges in the same pass, without join or shuffle; several hand in their hits by row."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    cut = parts(benchmark, part_bytes)
    first, more = next(cut), next(cut, None)
    if more is not None:
        numbered, _ = shared.stored(docs.withColumn("_quern_doc", F.monotonically_increasing_id()), "documents")
        bad, _ = shared.stored(scan(numbered, benchmark, part_bytes, ("_quern_doc",)).where(contaminated()).select("_quern_doc"), "contaminated")
        return numbered.join(bad, "_quern_doc", "left_anti").select(*docs.columns)
    get, _ = matcher_for(spark, first)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        match = get()
        for batch in batches:
            keep = []
            for raw in shared.as_bytes(batch.column(at)):
                words = words_of(raw)
                n = sum(e - s for s, e in match.hits(words)[0])
                keep.append(not (n and 20 * n >= len(words)))
            yield batch.filter(pa.array(keep))
        shared.release()

    return docs.mapInArrow(run, docs.schema)


def brute_force(text: str | None, items: list[tuple[int, str | None]]) -> tuple[int, int, int, str, bool]:
    """The contract by comparing every window with every place, for tests."""
    words, hit, names = words_of((text or "").encode()), set(), set()
    for name, item in items:
        for w in windows(words_of((item or "").encode())):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    names |= {str(name)} - {"None"}
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT cast(item_id AS VARCHAR) AS item, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(ws)) AS k, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS s FROM b, unnest(range(1, greatest(1, len(ws) - 12) + 1)) t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT k FROM win),
placed AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS s FROM w, sizes, unnest(range(1, len(ws) - k + 2)) t(i) WHERE len(ws) >= k),
m AS (SELECT doc_id, i, placed.k, item FROM placed JOIN win USING (k, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + k)) t(p) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT doc_id, cast(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM w LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLES = {"op6_decontaminate": ORACLE}
