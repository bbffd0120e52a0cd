"""Repeated byte strings by a distributed difference-cover sort.

Positions whose offset modulo V lies in a perfect difference set are sampled: for any two positions there is a shift below V
that brings both onto samples. Blocks of 3**LEVELS bytes get names by recursion on triples: the name of a block is made from the
names of its three thirds. Sampled names are dealt out by range, sorted, and compared with their neighbours; a string of
`length` bytes that occurs twice holds, at one shift, a sampled block that occurs twice. Only suffixes that begin at most V - 1
bytes before a repeated sample are merged: their names over the whole `length` bytes are sorted and neighbours are
compared. Names are hashes, not ranks: what is sorted is names, not texts (why, with figures: README).

Of equal texts (same SHA-256) one is read for all, as what it has the others have too; a text of `length` bytes and more that
stands twice loses every byte. What travels is names (8 bytes) and bit masks; texts travel only where a document has a
repeated sample. A name that repeats within a batch is settled there and sent once, so
that a passage of which there are very many weighs one name for each batch, not one for each place.

Null and empty texts have no bytes. Repeated rows are copies and lose every byte from `length` on. Matches never cross rows.
Very long texts are cut into pieces that overlap by `length`. Names are 64-bit: of N candidate starts, N * N / 2**65 pairs of
different strings share one (about 3 million among 10**13 starts of 100 TB). So starts whose names repeat are named again
under a second, independent key, and only those that repeat under it as well are removed: of a string that stands once to be removed, it has
to meet another in both, which less than one is expected to do at that size (6 million false starts by 10**12 claimed ones by 2**-64).
Rows are told apart by doc_id and a hash of the text, so equal rows are copies of each other; rows with a
null doc_id are returned whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import shared

LENGTH = 400
#: Bytes of text that one step in a worker holds at once.
PIECE = 4 << 20
#: Names that one task merges, as intended; rows of ids or digests (at most 40 bytes each) that are broadcast to a scan of texts, beyond which Spark joins by sorting.
NAMES_A_BUCKET = 3_000_000
BROADCAST_ROWS = 1_000_000
U = np.uint64
COEFFICIENTS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)]


@cache
def difference_set(q: int) -> tuple[int, ...] | None:
    """A perfect difference set modulo q*q + q + 1 for a prime q: the powers of a root of a cubic that lie on a line."""
    v = q * q + q + 1
    for a, b, c in product(range(q), repeat=3):  # x^3 = a x^2 + b x + c
        if any((r**3 - a * r * r - b * r - c) % q == 0 for r in range(q)):
            continue
        x, found = (1, 0, 0), []
        for i in range(v):
            if x[2] == 0:
                found.append(i)
            x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
        if len(found) == q + 1 and len({(i - j) % v for i in found for j in found}) == v:
            return tuple(found)
    return None


@cache
def plan(length: int) -> tuple[int, int, tuple[int, ...]]:
    """(levels, v, difference set): blocks of 3**levels bytes, and the largest cover that leaves room for one."""
    levels = 0
    while 3 ** (levels + 1) <= length / 4:
        levels += 1
    room = length - 3**levels + 1
    primes = [q for q in range(2, int(room**0.5) + 1) if all(q % i for i in range(2, q)) and q * q + q + 1 <= room]
    for q in reversed(primes):
        if found := difference_set(q):
            return levels, q * q + q + 1, found
    return levels, 1, (0,)


@cache
def thirds(key: int, level: int) -> np.ndarray:
    """Odd factors of the three thirds, of their own for each key and level: were they the same in two levels, their products would not tell apart a byte of one third from one of another."""
    return shared.mix(np.arange(3, dtype=U) + U(1 + 3 * (key + 2 * level))) | U(1)


def block_names(data: np.ndarray, levels: int, key: int = 0) -> np.ndarray:
    """Names of the 3**levels bytes from each position, by the first or second key; the last 3**levels - 1 positions have none."""
    names = data.astype(U) + U(1)
    for level in range(levels):
        step = 3**level
        n = len(names) - 2 * step
        if n <= 0:
            return np.zeros(0, U)
        one, two, three = thirds(key, level)
        third = names[:n] * one
        third += names[step : step + n] * two
        third += names[2 * step : 2 * step + n] * three
        names = shared.mix(third) if level else third
    return names


def whole_names(names: np.ndarray, size: int, length: int, at: np.ndarray, key: int = 0) -> np.ndarray:
    """Names of `length` bytes from each position in at, from the names of blocks of size bytes that cover them."""
    offsets = [*range(0, length - size, size), length - size]
    out = np.zeros(len(at), U)
    for i, o in enumerate(offsets):
        out = out * U(31) + names[at + o] * COEFFICIENTS[(i + key) % len(COEFFICIENTS)]
    return shared.mix(out)


def sampled(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, names) of one document's samples."""
    levels, v, cover = plan(length)
    size, n = 3**levels, len(raw)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, U)
    positions = (np.arange(0, n, v)[:, None] + np.array(cover)).ravel()
    positions = positions[positions <= n - size]
    out = np.empty(len(positions), U)
    data = np.frombuffer(raw, np.uint8)
    for start in range(0, n - size + 1, PIECE):
        lo, hi = np.searchsorted(positions, (start, min(n - size + 1, start + PIECE)))
        out[lo:hi] = block_names(data[start : start + PIECE + size - 1], levels)[positions[lo:hi] - start]
    return positions, out


def starts(raw: bytes, repeated: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, names over length) of the suffixes that come at most V - 1 bytes before a repeated sample."""
    _, v, _ = plan(length)
    n = len(raw)
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, np.maximum(0, repeated - (v - 1)), 1)
    np.add.at(edge, repeated + 1, -1)
    at = np.flatnonzero(np.cumsum(edge)[: max(0, n - length + 1)] > 0)
    return at, names_at(raw, at, length)


def names_at(raw: bytes, at: np.ndarray, length: int, key: int = 0) -> np.ndarray:
    """Names over length, by the first or second key, of the suffixes that begin at the places at (ascending)."""
    levels = plan(length)[0]
    size, out = 3**levels, np.empty(len(at), U)
    data = np.frombuffer(raw, np.uint8)
    i = 0
    while i < len(at):  # pieces that begin at a candidate, so that text between them is not named
        j = np.searchsorted(at, at[i] + PIECE)
        gaps = np.flatnonzero(np.diff(at[i:j]) > 4 * length)
        j = i + gaps[0] + 1 if len(gaps) else j
        first = at[i]
        names = block_names(data[first : at[j - 1] + length], levels, key)
        out[i:j] = whole_names(names, size, length, at[i:j] - first, key)
        i = j
    return out


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of names, as even as names are."""
    return ((names >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def dealt(ids: list[tuple[int, int]], lists: list[np.ndarray], copied: list[bool], buckets: int) -> Iterator[dict]:
    """For each bucket, what a batch sends: names that are single in it in document order, names settled in it (met twice, or in a copied text), and by document how many names there are and which were single. Copied texts ask for no answer."""
    names = np.concatenate(lists) if lists else np.zeros(0, U)
    if not len(names):
        return
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    sure = np.array(copied, bool)[owner]
    told = np.array(ids, np.int64).tobytes()  # once for the batch, with its first bucket
    batch = int(shared.mix(shared.mix(np.array(ids, np.int64).view(U)) + np.arange(len(ids), dtype=U)[:, None]).sum(dtype=U) >> U(1))
    bucket = bucket_of(names, buckets)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        mine = order[ends[b] : ends[b + 1]]
        if not len(mine):
            continue
        own = names[mine]
        rank = np.argsort(own, kind="stable")
        line = own[rank]
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        size = np.diff(np.concatenate((first, [len(line)])))
        known = (size > 1) | (np.add.reduceat(sure[mine][rank].astype(np.int64), first) > 0)
        single = np.empty(len(line), bool)
        single[rank] = np.repeat(~known, size)
        asks = ~sure[mine]
        who, counts = np.unique(owner[mine[asks]], return_counts=True)
        yield {
            "bucket": b, "batch": batch, "single": own[single].tobytes(), "settled": line[first[known]].tobytes(),
            "ids": told, "who": who.astype(np.uint16).tobytes(), "counts": short(counts), "mask": np.packbits(single[asks]).tobytes(),
        }
        told = b""


def short(counts: np.ndarray) -> bytes:
    """Positive counts in a byte each, or in four where one is larger."""
    return counts.astype(np.uint8 if len(counts) and counts.max() < 256 else np.uint32).tobytes()


def counts_of(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == n else np.uint32).astype(np.int64)


def repeated_in(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sorts the names of one bucket, compares neighbours, and answers each batch: a mask of the names that repeat, over all of its documents."""
    singles = [np.frombuffer(x, U) for x in pdf["single"]]
    ends = np.cumsum([0, *map(len, singles)])
    names = np.concatenate(singles)
    rank = np.argsort(names, kind="stable")
    line = names[rank]
    same = line[1:] == line[:-1]
    twice = np.zeros(len(line), bool)
    twice[1:] |= same
    twice[:-1] |= same
    settled = np.unique(np.concatenate([np.frombuffer(x, U) for x in pdf["settled"]]))
    if len(settled):
        at = np.minimum(np.searchsorted(settled, line), len(settled) - 1)
        twice |= settled[at] == line
    flags = np.empty(len(line), bool)
    flags[rank] = twice
    out = {"batch": [], "ids": [], "who": [], "counts": [], "mask": []}
    for i, (batch, ids, who, counts, mask) in enumerate(zip(*(pdf[c] for c in out), strict=True)):
        total = int(counts_of(counts, len(who) // 2).sum())
        single = np.unpackbits(np.frombuffer(mask, np.uint8), count=total).astype(bool)
        hit = ~single
        asked = int(single.sum())  # copied texts' names stand in `settled` alone
        hit[single] = flags[ends[i] : ends[i] + asked]
        if hit.any() or ids:
            for k, v in zip(out, (batch, ids, who, counts, np.packbits(hit).tobytes()), strict=True):
                out[k].append(v)
    return pd.DataFrame(out).assign(bucket=int(pdf["bucket"].iloc[0]))[["batch", "bucket", "ids", "who", "counts", "mask"]]


def by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """The answers of all buckets to one batch, for each of its documents that has a repeated name: the buckets, ascending, and their masks end to end."""
    pdf = pdf.sort_values("bucket").drop_duplicates("bucket")  # equal rows may make equal batches
    ids = np.frombuffer(next(x for x in pdf["ids"] if x), np.int64).reshape(-1, 2)
    parts: dict[int, list] = {}
    for bucket, who, counts, mask in zip(pdf["bucket"], pdf["who"], pdf["counts"], pdf["mask"], strict=True):
        who = np.frombuffer(who, np.uint16)
        if not len(who):
            continue
        stops = np.cumsum(counts_of(counts, len(who)))
        hit = np.unpackbits(np.frombuffer(mask, np.uint8), count=int(stops[-1])).astype(bool)
        some = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], stops[:-1]))) > 0
        for k in np.flatnonzero(some):
            parts.setdefault(int(who[k]), []).append((bucket, hit[stops[k - 1] if k else 0 : stops[k]]))
    found = [{"buckets": np.array([b for b, _ in p], np.uint32).tobytes(), "mask": np.packbits(np.concatenate([h for _, h in p])).tobytes()} for p in parts.values()]
    own = ids[list(parts)] if parts else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"doc_id": own[:, 0], "mark": own[:, 1], "found": pd.Series(found, dtype=object)}).astype({"doc_id": "int64", "mark": "int64"})


def flags_of(names: np.ndarray, buckets: int, found: dict) -> np.ndarray:
    """Which of a document's names repeat, from the answers of the buckets."""
    bucket = bucket_of(names, buckets)
    asked = np.flatnonzero(np.isin(bucket, np.frombuffer(found["buckets"], np.uint32)))
    if -(-len(asked) // 8) != len(found["mask"]):
        raise ValueError("a document changed between two readings")
    hit = np.zeros(len(names), bool)
    hit[asked[np.argsort(bucket[asked], kind="stable")]] = np.unpackbits(np.frombuffer(found["mask"], np.uint8), count=len(asked)).astype(bool)
    return hit


def exchange(sent: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Answers by document: doc_id, mark, found (buckets, mask); only documents with a repeated name."""
    answers = sent.groupBy("bucket").applyInPandas(repeated_in, "batch long, bucket int, ids binary, who binary, counts binary, mask binary")
    found = answers.groupBy("batch").applyInPandas(by_document, "doc_id long, mark long, found struct<buckets: binary, mask: binary>")
    return shared.stored(found.groupBy("doc_id", "mark").agg(F.first("found").alias("found")), label)  # equal rows have equal answers


SENT = "bucket int, batch long, single binary, settled binary, ids binary, who binary, counts binary, mask binary"


def sender(names_of: Callable, buckets: int) -> Callable:
    """Maps batches of doc_id, text, mark, copied, found to what is sent; names_of gets the bytes of a text and its found."""

    def run(batches):
        import pyarrow as pa

        ids, lists, copied, held = [], [], [], 0
        schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), *((n, pa.binary()) for n in ("single", "settled", "ids", "who", "counts", "mask"))])

        def flush():
            rows = list(dealt(ids, lists, copied, buckets))
            for x in (ids, lists, copied):
                x.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema) if rows else None

        for batch in batches:
            found = batch.column(4).to_pylist() if batch.num_columns > 4 else [None] * batch.num_rows
            for doc, raw, mark, twin, f in zip(batch.column(0).to_pylist(), shared.as_bytes(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3)), found, strict=True):
                names = names_of(raw, f)
                if len(names):
                    ids.append((doc, mark))
                    lists.append(names)
                    copied.append(twin)
                    held += len(names)
                if held > 1_500_000 or len(ids) > 60_000:
                    if (out := flush()) is not None:
                        yield out
                    held = 0
        if (out := flush()) is not None:
            yield out
        shared.release()

    return run


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, mark, digest (SHA-256 of the bytes), n_bytes."""
    text = F.col("text").cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("mark"), F.unhex(F.sha2(raw, 256)).alias("digest"), F.length(raw).cast("long").alias("n_bytes"))


def bounded(df: DataFrame) -> DataFrame:
    """To be broadcast, if its rows are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that found has answers for; texts of others aren't dealt out."""
    some = docs.join(bounded(found.select("doc_id", "mark")), ["doc_id", "mark"], "left_semi")
    return some.join(found, ["doc_id", "mark"]).select("doc_id", "text", "mark", "copied", "found")


def buckets_for(names: float) -> int:
    """Ranges of names, of NAMES_A_BUCKET at most as names are even; they grow with the names, not with the setting for other shuffles."""
    return max(16, int(names) // NAMES_A_BUCKET + 1)


def claimed(raw: bytes, found: dict, again: dict | None, length: int, buckets: tuple[int, ...]) -> np.ndarray:
    """Starts of one document whose first names repeat; all near a repeated sample, where no answer on them was asked for."""
    positions, names = sampled(raw, length)
    at, whole = starts(raw, positions[flags_of(names, buckets[0], found)], length)
    return at if again is None else at[flags_of(whole, buckets[1], again)]


def covered(raw: bytes, answers: dict, length: int, buckets: tuple[int, int, int]) -> np.ndarray:
    """Removed bytes of one document: of the starts claimed by first names, those whose second names repeat too."""
    first = claimed(raw, answers["found"], answers["again"], length, buckets)
    first = first[flags_of(names_at(raw, first, length, 1), buckets[2], answers["sure"])]
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + length, -1)
    return np.cumsum(edge)[:-1] > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes, null if all remain), whole_sha (of the text, where all remains)."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    texts = marked(docs)
    long_ones = texts.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= length))
    classes, _ = shared.stored(long_ones.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("n_bytes").alias("bytes"), F.count("*").alias("n")), "classes")
    copies = bounded(classes.where("n > 1").select("digest", "first"))
    every = texts.join(copies, "digest", "left").withColumn("copied", F.col("first").isNotNull() & F.col("doc_id").isNotNull())
    # of equal texts one is read for all: what it has, the others have too
    own = every.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= length) & (~F.col("copied") | (F.col("doc_id") == F.col("first")))).select("doc_id", "text", "mark", "copied")
    _, v, cover = plan(length)
    size = classes.agg(F.sum("bytes")).first()[0] or 0
    one = buckets or buckets_for(size * len(cover) / v)
    samples, _ = exchange(own.select("doc_id", "text", "mark", F.lit(False).alias("copied")).mapInArrow(sender(lambda raw, _: sampled(raw, length)[1], one), SENT), "samples")
    part, part_path = shared.stored(joined(own, samples), "part")

    def merged(raw: bytes, found: dict) -> np.ndarray:
        positions, names = sampled(raw, length)
        return starts(raw, positions[flags_of(names, one, found)], length)[1]

    two = buckets or buckets_for(part.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    suffixes, _ = exchange(part.mapInArrow(sender(merged, two), SENT), "suffixes")
    again = part.join(suffixes.select("doc_id", "mark", F.col("found").alias("again")), ["doc_id", "mark"], "left").where("copied OR again IS NOT NULL")
    again, _ = shared.stored(again.select("doc_id", "text", "mark", "copied", F.struct("found", "again").alias("found")), "again")
    shared.remove(spark, part_path)  # its rows that still matter stand in `again`

    def confirmed(raw: bytes, answers: dict) -> np.ndarray:
        return names_at(raw, claimed(raw, answers["found"], answers["again"], length, (one, two)), length, 1)

    suffixes, _ = exchange(again.mapInArrow(sender(confirmed, two), SENT), "confirmed")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, whole_sha string"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = {"n_bytes": [], "n_removed": [], "n_spans": []}
            kept = []
            for raw, answers in zip(shared.as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                gone = covered(raw, answers, length, (one, two, two))
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0]) if len(gone) else 0)
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out.values()), pa.array(kept, pa.binary()), pa.nulls(len(kept), pa.string())], names=["doc_id", *out, "kept", "whole_sha"])
        shared.release()

    sure = suffixes.select("doc_id", "mark", F.col("found").alias("sure"))
    cut = again.where("NOT copied").join(sure, ["doc_id", "mark"]).select("doc_id", "text", F.struct("found.*", "sure").alias("answers")).mapInArrow(run, schema)
    # of documents without a repeat, and of copies, only what is returned is dealt out
    zero, sha = F.lit(0).cast("long"), F.lower(F.hex("digest"))
    rest = every.select("doc_id", "mark", "n_bytes", "copied", "digest").join(suffixes.select("doc_id", "mark"), ["doc_id", "mark"], "left_anti")
    rest = rest.select(
        "doc_id", "n_bytes", F.when(F.col("copied"), F.col("n_bytes")).otherwise(zero).alias("n_removed"), F.col("copied").cast("long").alias("n_spans"),
        F.when(F.col("copied"), F.lit(b"")).alias("kept"), F.when(~F.col("copied"), sha).alias("whole_sha"),
    )
    return cut.unionByName(rest)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(shared.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce(F.sha2("kept", 256), F.col("whole_sha")).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The contract by counting every string, for tests."""
    raws = {d: (t or "").encode() for d, t in rows}
    seen: dict[bytes, int] = {}
    for raw in raws.values():
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = {}
    for d, raw in raws.items():
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


ORACLE = r"""
WITH b AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS raw, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, md5_number(hex(raw[i:i + 399])) AS h FROM b, unnest(range(1, n - 398)) t(i) WHERE n >= 400),
d AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
f AS (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM d)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + 399 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
e AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
p AS (SELECT b.doc_id, before + 1 AS x, hex(raw[before + 1:a - 1]) AS part FROM e JOIN b ON b.doc_id = e.doc_id WHERE a > before + 1
  UNION ALL SELECT b.doc_id, z + 1, hex(raw[z + 1:n]) FROM b JOIN (SELECT doc_id, max(z) AS z FROM r GROUP BY doc_id) l ON l.doc_id = b.doc_id WHERE z < n),
k AS (SELECT doc_id, string_agg(part, '' ORDER BY x) AS kept FROM p GROUP BY doc_id),
c AS (SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(CASE WHEN n_removed IS NULL THEN raw ELSE unhex(coalesce(kept, '')) END) AS kept_sha256 FROM b LEFT JOIN c ON c.doc_id = b.doc_id LEFT JOIN k ON k.doc_id = b.doc_id
"""
QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES = {"op4_suffix_dedup": ORACLE}
