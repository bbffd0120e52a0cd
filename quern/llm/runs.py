"""Periodic runs in texts: all maximal stretches of words that repeat with a period at least `least` times, and texts without the repetitions.

Each batch of texts is worked on as one sequence of word numbers in which no stretch of one text equals one of another. Prefix doubling
gives the suffix array, the names of all stretches of 2^k words (whose equality answers by how far two places agree), and the LCP
array. The nearest smaller places before and after each suffix in the array, reached by jumps, give the longest previous factor (LPF) of each
place, and with it the blocks of the LZ factorisation. A run that touches the border of a block, b <= s <= e, with its end in the block or at its end, has a
period below (length of the block before + length of the block) / (least - 1), since otherwise the block before would have
been longer; so all borders have at most 2n / (least - 1) periods together. Each is tested by the names at one distance either
side, and what remains is extended to both sides (Main). A run strictly inside a block is a copy of an earlier one: blocks are gone through from left to right, and
the runs that begin in the source of a block, found in buckets by their beginning, are copied.

A period found is the smallest one of its stretch: of equal stretches the smallest is kept, and a smaller one would have been found, too.

Null, empty and blank texts have no words and no runs. Texts of equal words are one run. Repeated rows each get a row; a null doc_id is kept.
A text is never cut: memory is some (80 + 4 log2(longest repeat)) bytes a word of a batch or of one longer text. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import shared
from quern.llm.merkle import crc_sql

LEAST, SHORTEST = 4, 6
#: Words that are worked on at once, unless a single text has more.
PART = 1 << 16


class Suffixes:
    """Suffix array, LCP array and names of stretches of a sequence whose stretches of repeats all end before its end."""

    def __init__(self, first: np.ndarray) -> None:
        n = len(first)
        self.array = np.argsort(first, kind="stable").astype(np.int32)
        found = first[self.array]
        fresh = np.concatenate([[True], found[1:] != found[:-1]])
        slots = np.arange(n, dtype=np.int32)
        heads = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank = np.empty(n, np.int32)
        rank[self.array] = heads
        self.names, self.lcp = [rank], np.zeros(n, np.int32)
        alone = fresh & np.concatenate([fresh[1:], [True]])
        slots, h = slots[~alone], 1
        while len(slots):
            own = self.array[slots]
            key = rank[own].astype(np.int64) * n + rank[own + h]
            order = np.argsort(key, kind="stable")
            key, own = key[order], own[order]
            self.array[slots] = own
            group = key // n
            other = np.concatenate([[True], group[1:] != group[:-1]])
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            at = np.flatnonzero(fresh & ~other)
            self.lcp[slots[at]] = h + self.ahead(own[at - 1] + h, own[at] + h)
            rank = rank.copy()
            rank[own] = np.maximum.accumulate(np.where(fresh, slots, 0))
            self.names.append(rank)
            alone = fresh & np.concatenate([fresh[1:], [True]])
            slots, h = slots[~alone], 2 * h

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and j on, i <> j."""
        return self._agree(i, j, 1)

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree up to i and j, they included; i < j."""
        return self._agree(i, j, -1)

    def _agree(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        i, j, out = i.astype(np.int64), j.astype(np.int64), np.zeros(len(i), np.int32)
        for k in range(len(self.names) - 1, -1, -1):
            step, name = 1 << k, self.names[k]
            a, b = (i, j) if way > 0 else (i - step + 1, j - step + 1)
            inside = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < len(name))
            same = inside & (name[np.where(inside, a, 0)] == name[np.where(inside, b, 0)])
            out[same] += step
            i, j = i + way * step * same, j + way * step * same
        return out

    def previous(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place the length of its longest previous factor, and where that begins."""
        n, best, source = len(self.array), np.zeros(len(self.array), np.int32), np.zeros(len(self.array), np.int32)
        edge = np.concatenate([self.lcp, [0]])
        for way in (-1, 1):
            to = np.arange(n, dtype=np.int32) + np.int32(way)
            low = (edge[:-1] if way < 0 else edge[1:]).copy()
            todo = np.flatnonzero(low > 0)
            while len(todo := todo[self.array[to[todo]] > self.array[todo]]):
                via = to[todo]
                low[todo], to[todo] = np.minimum(low[todo], low[via]), to[via]
                todo = todo[low[todo] > 0]
            better = np.flatnonzero(low > best[self.array])
            best[self.array[better]], source[self.array[better]] = low[better], self.array[to[better]]
        return best, source


def blocks(factor: np.ndarray) -> np.ndarray:
    """Where the LZ blocks begin."""
    steps, at, out = np.maximum(factor, 1).tolist(), 0, []
    while at < len(steps):
        out.append(at)
        at += steps[at]
    return np.array(out, np.int64)


def at_borders(words: Suffixes, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of the runs that touch a border of blocks."""
    n, top = len(words.array), len(words.names)
    size = np.diff(np.append(starts, n))
    limit = (np.concatenate([[0], size[:-1]]) + size - 1) // (least - 1)
    # one side agrees over at least half of (least - 1) periods, and no two places agree over 2^top words
    limit = np.minimum(limit, (2 << top) // (least - 1))
    border = np.repeat(starts, limit)
    period = np.arange(len(border)) - np.repeat(np.cumsum(limit) - limit, limit) + 1
    i = np.concatenate([border, border - period])
    period = np.concatenate([period, period])
    level = np.frexp(((least - 1) * period + 1) // 2)[1] - 1
    fits = (i >= 0) & (i + period < n) & (level < top)
    i, period, level = i[fits], period[fits], level[fits]
    near = np.zeros(len(i), bool)
    for k in range(top):
        of = np.flatnonzero(level == k)
        a, b, name = i[of], i[of] + period[of], words.names[k]
        back = a - (1 << k)
        near[of] = (name[a] == name[b]) | ((back >= 0) & (name[np.maximum(back, 0)] == name[np.maximum(back, 0) + period[of]]))
    i, period = i[near], period[near]
    ahead, behind = words.ahead(i, i + period), words.behind(i - 1, i + period - 1)
    good = (ahead + behind >= (least - 1) * period)
    return (i - behind)[good], (i + period + ahead)[good], period[good]


def runs_of(codes: np.ndarray, texts: np.ndarray, least: int = LEAST, shortest: int = SHORTEST) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """codes: word numbers of all texts after one another; texts: how many words each has. (text, [(begin, length, period)]) of texts with runs, in order."""
    ends = np.cumsum(texts)
    own = np.repeat(np.arange(len(texts)), texts)
    kinds = int(codes.max(initial=0)) + 2
    # after each text a word of its own, so that nothing reaches from one text into another
    first = np.insert(own * kinds + codes, ends, np.arange(len(texts)) * kinds + kinds - 1)
    begins = ends - texts + np.arange(len(texts))
    words = Suffixes(first)
    factor, source = words.previous()
    starts = blocks(factor)
    begin, end, period = at_borders(words, starts, least)
    if not len(begin):
        return
    where = np.searchsorted(begins, begin, "right") - 1
    size = np.diff(np.append(starts, len(first)))
    large = np.flatnonzero(size >= max(shortest, least) + 2)
    owner = np.searchsorted(begins, starts[large], "right") - 1
    for t in np.unique(where).tolist():
        of = where == t
        buckets: dict[int, dict[int, int]] = {}
        for b, e, p in zip(begin[of].tolist(), end[of].tolist(), period[of].tolist(), strict=True):
            known = buckets.setdefault(b, {})
            known[e] = min(p, known.get(e, p))
        keys = sorted(buckets)
        for block in large[owner == t].tolist():
            at, length = int(starts[block]), int(size[block])
            since = int(source[at])
            k = bisect_right(keys, since)
            while k < len(keys) and keys[k] < since + length:
                for e, p in list(buckets[keys[k]].items()):
                    if e < since + length:
                        b = keys[k] + at - since
                        if b not in buckets:
                            insort(keys, b)
                        buckets.setdefault(b, {}).setdefault(e + at - since, p)
                k += 1
        base = int(begins[t])
        found = [(b - base, e - b, p) for b, known in buckets.items() for e, p in known.items() if e - b >= max(shortest, least * p)]
        if found:
            yield t, sorted(found, key=lambda r: (r[0], r[2]))


def parts(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PART words."""
    at, held = 0, 0
    for i, n in enumerate(counts.tolist()):
        if held and held + n > PART:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(counts):
        yield at, len(counts)


def find(docs: DataFrame, rewrite: Callable[[int | None, int], np.ndarray | None] | None = None, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (begin and length in words, period; by begin, then period) and collapsed: the words, joined by one space, without
    the words of each run after its first period. rewrite: from doc_id and the number of words to the numbers of the words to take in their place, or None."""
    shared.small_batches(docs.sparkSession)

    def batch_runs(batch: pa.RecordBatch) -> dict:
        words, counts = shared.split_words(batch.column(1))
        starts, ids = np.cumsum(counts) - counts, batch.column(0).to_pylist()
        if rewrite:
            taken = [rewrite(d, n) for d, n in zip(ids, counts.tolist(), strict=True)]
            if any(t is not None for t in taken):
                every = np.arange(len(words))
                for s, n, t in zip(starts.tolist(), counts.tolist(), taken, strict=True):
                    if t is not None:
                        every[s : s + n] = s + t
                words = words.take(pa.array(every))
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found: list = [[] for _ in ids]
        drop = np.zeros(len(words) + 1, np.int32)
        for a, b in parts(counts):
            low = int(starts[a])
            for t, runs in runs_of(codes[low : low + int(counts[a:b].sum())], counts[a:b], least, shortest):
                found[a + t] = runs
                for begin, length, period in runs:
                    drop[starts[a + t] + begin + period] += 1
                    drop[starts[a + t] + begin + length] -= 1
        kept = np.cumsum(drop[:-1]) == 0
        left = np.zeros(len(words) + 1, np.int64)
        np.cumsum(kept, out=left[1:])
        if not kept.all():
            words = words.filter(pa.array(kept))
        offsets = left[np.append(starts, len(kept))]
        collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), words), pa.scalar(" ", pa.large_string()))
        return {"doc_id": batch.column(0), "n_words": counts, "runs": [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], "collapsed": collapsed.cast(pa.string())}

    return shared.arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), batch_runs, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's repetitions: in one of ten documents the words from a place on repeat a few words."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(shared.table(spark, sf_dir, "documents"), planted)
    # the greatest length / period without rounding: a's is greater than b's if length a * period b is
    best = F.array_sort(F.col("runs"), lambda a, b: F.coalesce(
        F.nullif(F.signum(b["length"] * a["period"] - a["length"] * b["period"]).cast("int"), F.lit(0)), F.nullif(F.signum(a["start"] - b["start"]).cast("int"), F.lit(0)), F.signum(a["period"] - b["period"]).cast("int")))[0]
    out = found.withColumn("best", F.when(F.size("runs") > 0, best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def brute_force(words: list, least: int = LEAST, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(begin, length, period) by trying all periods at all places, for tests."""
    n, found = len(words), {}
    for p in range(1, n // least + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(shortest, least * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((b, e - b, p) for (b, e), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed_by_hand(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {i for b, n, p in runs for i in range(b + p, b + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def row_by_hand(doc_id: int | None, text: str | None) -> tuple:
    """The query's row, for tests."""
    words = [w.decode() for w in (text or "").encode().split()]
    taken = planted(doc_id, len(words))
    words = words if taken is None else [words[i] for i in taken]
    runs = brute_force(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{b},{n},{p}\n" for b, n, p in runs), collapsed_by_hand(words, runs))]
    return (doc_id, len(runs), *shown, *sha)


ORACLE = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, {crc_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
g AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g FROM w),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
q AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
v AS MATERIALIZED (SELECT doc_id, n, CASE WHEN p IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS ws FROM q),
x AS MATERIALIZED (SELECT doc_id, n, i, ws[i + 1] AS word FROM v, unnest(range(n)) t(i)),
e AS (SELECT x.doc_id, y.i - x.i AS d, x.i FROM x JOIN x y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
k AS (SELECT doc_id, d, i, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS k FROM e),
r AS MATERIALIZED (SELECT doc_id, b AS start, length, min(d) AS period FROM (SELECT doc_id, d, min(i) AS b, count(*) + d AS length FROM k GROUP BY doc_id, d, k) WHERE length >= greatest(6, 4 * d) GROUP BY doc_id, b, length),
m AS (SELECT doc_id, count(*) AS n_runs, first(r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
j AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i WHERE c.i IS NULL GROUP BY x.doc_id)
SELECT v.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM v LEFT JOIN m USING (doc_id) LEFT JOIN j USING (doc_id)
"""
QUERIES = {"op11_runs": op11_runs}
ORACLES = {"op11_runs": ORACLE}
