"""Language-model scores from an Elias-Fano n-gram trie of order three.

Level one holds the words: their fingerprints as a monotone sequence, in ranges, so that a word's number is its place. On levels two
and three a context is an entry of the level above (a word; a pair of words), and pointers, a monotone sequence, say where a context's
successors begin. The successors' numbers follow relative to that context (context times vocabulary size plus successor), again one
monotone sequence a range. An n-gram is looked up by the successor search between the two pointers of its context. With every entry
stands a quantised probability; with every context its back-off weight.

    p(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p(w|v)   = max(c(v,w) - D, 0) / c(v) + D T(v) / c(v) p(w),              T(v): distinct successors of v
    p(w|u,v) = max(c(u,v,w) - D, 0) / c(u,v) + D T(u,v) / c(u,v) p(w|v)

Level two stores p(w|v) itself, level three the first term, to which a score adds the weighted p(w|v) it has just read.

Levels are counted over all training documents in ranges: workers send each batch's distinct keys with counts, one task
a range merges them and writes its files to the shared folder, and scorers memory-map them. There are as many ranges as keep what a
task merges near TOKENS_A_RANGE tokens' n-grams. Nothing but the number of entries of each range passes through the driver, and
nothing is broadcast; the files grow with the corpus and are read where needed.

Null and empty texts have one token, the end. Words are of any length. Repeated rows are counted as often as they occur. With
no training token at all every probability is that of an unseen word in an empty vocabulary. A null doc_id is hashed as "".
Fingerprints have 56 bits: two of V words share one with a probability of V * V / 2**57 (7e-6 for a million words).
"""

from __future__ import annotations

import io
import math
import os
import re
import zlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import shared
from quern.llm.elias_fano import EliasFano, encode

U = np.uint64
DISCOUNT = 0.75
#: Steps of the quantised log10 probabilities: 1 / STEPS each, in 16 bits.
STEPS = 4096
M = U(0xD6E8FEB86659FD93)
END = b""
#: Words that a worker reads before it sends their counts.
HELD = 1_500_000
#: Tokens, or bytes of text where tokens aren't counted yet, whose n-grams one range takes.
TOKENS_A_RANGE, BYTES_A_RANGE = 4_000_000, 64 << 20
#: Tokens from which the batches of a range are merged in so many parts first.
TOKENS_A_PART = 200_000_000


class Store:
    """Arrays in the shared folder; memory-mapped where its file system is mounted, else read through pyarrow."""

    def __init__(self, path: str) -> None:
        self.path = re.sub(r"^s3[an]:", "s3:", path)  # the schemes of Hadoop's clients for the same store
        self.local = path.removeprefix("file://") if path.startswith(("file:/", "/")) else None
        if self.local and self.local.startswith("file:"):
            self.local = self.local.removeprefix("file:")

    def write(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        for part, a in arrays.items():
            held = io.BytesIO()
            np.save(held, a)
            if self.local:
                os.makedirs(self.local, exist_ok=True)
                own = f"{self.local}/.{name}-{part}-{os.getpid()}-{os.urandom(4).hex()}"
                with open(own, "wb") as f:
                    f.write(held.getbuffer())
                os.replace(own, f"{self.local}/{name}-{part}.npy")
            else:
                from pyarrow import fs

                at, base = fs.FileSystem.from_uri(self.path)
                at.create_dir(base)
                with at.open_output_stream(f"{base}/{name}-{part}.npy") as f:
                    f.write(held.getbuffer())

    def read(self, name: str, parts: tuple[str, ...]) -> dict[str, np.ndarray]:
        if self.local:
            return {p: np.load(f"{self.local}/{name}-{p}.npy", mmap_mode="r") for p in parts}
        from pyarrow import fs

        at, base = fs.FileSystem.from_uri(self.path)
        return {p: np.load(io.BytesIO(at.open_input_file(f"{base}/{name}-{p}.npy").read())) for p in parts}


PARTS = ("low", "high", "zeros", "meta")


def training(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 != 0


class Vocabulary:
    """Level one: fingerprint -> number and count, over all ranges."""

    def __init__(self, store: Store, sizes: list[int]) -> None:
        self.store, self.first = store, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.ranges: dict[int, tuple] = {}
        self.size = int(self.first[-1])
        self.n = len(sizes)

    def of(self, r: int) -> tuple[EliasFano, np.ndarray]:
        if r not in self.ranges:
            got = self.store.read(f"words{r}", (*PARTS, "counts"))
            self.ranges[r] = (EliasFano(got), got["counts"])
        return self.ranges[r]

    def look(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (size for unknown words) and counts of distinct sorted fingerprints."""
        numbers, counts = np.full(len(prints), self.size, np.int64), np.zeros(len(prints), np.int64)
        ranges = range_of(prints, self.n)
        ends = np.searchsorted(ranges, np.arange(self.n + 1))
        for r in range(self.n):
            if ends[r] < ends[r + 1] and self.first[r] < self.first[r + 1]:
                ef, c = self.of(r)
                at = ef.find((prints[ends[r] : ends[r + 1]] >> U(8)) - U(start_of(r, self.n)))
                ok = at >= 0
                numbers[ends[r] : ends[r + 1]][ok] = self.first[r] + at[ok]
                counts[ends[r] : ends[r + 1]][ok] = c[at[ok]]
        return numbers, counts


def start_of(r: int, n: int) -> int:
    """The first fingerprint, without its empty bits, of the r-th of n ranges."""
    return -(-(r << 32) // n) << 24


def range_of(prints: np.ndarray, n: int) -> np.ndarray:
    return ((prints >> U(32)) * U(n) >> U(32)).astype(np.int64)


#: A word's fingerprint is a polynomial in BASE over one random number for each byte, mixed with its length; all words of a piece at once.
PIECE = 1 << 19
BASE = 0x9E3779B97F4A7C15
BYTES = np.random.default_rng(7).integers(0, 2**63, 256, np.uint64) * U(2) + U(1)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BLANKS = re.compile(rb"[\x20\t-\r]")
END_PRINT = U(0xE7037ED1A0B42800)


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    one = np.ones(1, U)
    return np.concatenate((one, np.cumprod(np.full(n - 1, BASE, U)))), np.concatenate((one, np.cumprod(np.full(n - 1, pow(BASE, -1, 1 << 64), U))))


def word_prints(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, fingerprints) of the words of lower-cased bytes; the low 8 bits of a fingerprint are left empty."""
    found, at = [], 0
    while at < len(raw):
        stop = len(raw)
        if stop - at > PIECE:  # cut at a blank; a word longer than a piece stays whole
            stop = at + PIECE
            while stop > at and not BLANK[raw[stop - 1]]:
                stop -= 1
            if stop == at:
                m = BLANKS.search(raw, at + PIECE)
                stop = m.end() if m else len(raw)
        data = np.frombuffer(raw, np.uint8, stop - at, at)
        up, down = powers(PIECE if stop - at <= PIECE else stop - at)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~BLANK[data]
        edge = np.diff(inside)
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(BYTES[data] * up[: len(data)], out=sums[1:])
        found.append((first + at, shared.mix((sums[end] - sums[first]) * down[first] + (end - first).astype(U) * M)))
        at = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]) & ~U(255)


def tokens_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, fingerprints end to end) of the tokens of texts, the end of each among them."""
    places, prints = word_prints(b" ".join(raws).lower())
    ends = np.searchsorted(places, np.cumsum([len(x) + 1 for x in raws]))
    return np.diff(ends, prepend=0) + 1, np.insert(prints, ends, END_PRINT)


def batches_of(batches, only_training: bool):
    """(doc ids, lengths, fingerprints end to end) of as many documents as hold about HELD tokens."""
    ids, lengths, found, held = [], [], [], 0
    for batch in batches:
        docs, raws = batch.column(0).to_pylist(), shared.as_bytes(batch.column(1))
        if only_training:
            some = [i for i, doc in enumerate(docs) if training(doc)]
            docs, raws = [docs[i] for i in some], [raws[i] for i in some]
        if not docs:
            continue
        n, prints = tokens_of(raws)
        ids += docs
        lengths.append(n)
        found.append(prints)
        held += len(prints)
        if held >= HELD:
            yield ids, np.concatenate(lengths), np.concatenate(found)
            ids, lengths, found, held = [], [], [], 0
    if ids:
        yield ids, np.concatenate(lengths), np.concatenate(found)


def sent(keys: np.ndarray, counts: np.ndarray, ends: np.ndarray):
    """One row for each range r, which has keys[ends[r]:ends[r + 1]] of the sorted keys: their gaps, byte by byte so that they compress, and their counts."""
    import pyarrow as pa

    rows = [{"range": r, "keys": gaps(keys[a:z]), "counts": narrow(counts[a:z])} for r, (a, z) in enumerate(zip(ends[:-1], ends[1:])) if a < z]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))


def gaps(keys: np.ndarray) -> bytes:
    return np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def ungapped(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(U)[:, 0], dtype=U)


def narrow(counts: np.ndarray) -> bytes:
    """Counts below 255 in a byte, larger ones after them."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def wide(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.int64, offset=n)
    return out


def merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = [ungapped(k) for k in pdf["keys"]]
    counts = np.concatenate([wide(c, len(k)) for c, k in zip(pdf["counts"], keys, strict=True)])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def part_merged(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, counts = merged(pdf)
    return pd.DataFrame({"range": pdf["range"].iloc[:1].to_numpy(), "keys": [gaps(keys)], "counts": [narrow(counts)]})


class Level:
    """Level two or three, over all ranges of contexts: bounds[r] is the first context of range r, firsts[r] the place of its first entry."""

    def __init__(self, store: Store, name: str, width: int, bounds: list[int], sizes: list[int]) -> None:
        self.store, self.name, self.width, self.sizes = store, name, U(width), sizes
        self.bounds, self.firsts = np.array(bounds, np.int64), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.ranges: dict[int, tuple] = {}

    def plain(self) -> tuple:
        """What makes it again in a worker."""
        return self.name, int(self.width), self.bounds.tolist(), self.sizes

    def of(self, r: int) -> tuple | None:
        if not self.sizes[r]:
            return None
        if r not in self.ranges:
            got = self.store.read(f"{self.name}{r}", (*PARTS, "codes", "backoff"))
            self.ranges[r] = EliasFano(got), EliasFano(self.store.read(f"{self.name}-pointers{r}", PARTS)), got["codes"], got["backoff"]
        return self.ranges[r]

    def write(self, r: int, keys: np.ndarray, codes: np.ndarray, kinds: np.ndarray, backoff: np.ndarray) -> None:
        """keys: relative to the range's first context, sorted; kinds: successors of each of its contexts."""
        self.store.write(f"{self.name}-pointers{r}", encode(np.concatenate(([0], np.cumsum(kinds))), len(keys) + 1))
        self.store.write(f"{self.name}{r}", encode(keys, len(kinds) * int(self.width)) | {"codes": quantised(codes), "backoff": quantised(backoff)})

    def successors(self, context: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words seen after a context, and their codes as log10, from where its pointer says they stand."""
        r = int(np.searchsorted(self.bounds, context, "right")) - 1
        if (got := self.of(r)) is None:
            return np.zeros(0, np.int64), np.zeros(0)
        keys, pointers, codes, _ = got
        first, stop = (int(x) for x in pointers.get(np.array([context - self.bounds[r], context - self.bounds[r] + 1])))
        return (keys.get(np.arange(first, stop)) % self.width).astype(np.int64), codes[first:stop].astype(np.float64) / -STEPS

    def look(self, context: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place or -1, log10 of the stored probability, log10 of the context's weight) of distinct (context, w), sorted."""
        place, code, weight = np.full(len(w), -1, np.int64), np.full(len(w), -np.inf), np.zeros(len(w))
        ends = np.searchsorted(context, self.bounds)
        for r in range(len(self.sizes)):
            a, z = ends[r], ends[r + 1]
            if a == z or (got := self.of(r)) is None:
                continue
            keys, pointers, codes, backoff = got
            own, where = np.unique(context[a:z] - self.bounds[r], return_inverse=True)
            begin, end = (pointers.get(x).astype(np.int64)[where] for x in (own, own + 1))
            weight[a:z] = (backoff[own].astype(np.float64) / -STEPS)[where]
            some = np.flatnonzero(begin < end)
            at = keys.find(own[where[some]].astype(U) * self.width + w[a:z][some].astype(U), begin[some], end[some])
            hit = at >= 0
            place[a + some[hit]] = self.firsts[r] + at[hit]
            code[a + some[hit]] = codes[at[hit]].astype(np.float64) / -STEPS
        return place, code, weight


def even(contexts: int, n: int) -> list[int]:
    """First contexts of n ranges."""
    return [contexts * r // n for r in range(n + 1)]


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-log10 * STEPS), 0, 65535).astype(np.uint16)


def log_p(counts: np.ndarray, tokens: int, size: int) -> np.ndarray:
    return np.log10((counts + 0.1) / (tokens + 0.1 * (size + 1)))


def words_in(words: Vocabulary, lengths: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and number of each token of a batch, and its count; the start of a text is context `size`, an unknown word `size + 1` as a context."""
    distinct, where = np.unique(prints, return_inverse=True)
    numbers, counts = words.look(distinct)
    w, c = numbers[where], counts[where]
    v = np.empty_like(w)
    v[1:] = np.where(w[:-1] == words.size, words.size + 1, w[:-1])
    v[starts_of(lengths)] = words.size
    return v, w, c


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)[:-1]))


class Trie:
    def __init__(self, words: Vocabulary, tokens: int, pairs: Level | None = None, triples: Level | None = None) -> None:
        self.words, self.tokens, self.pairs, self.triples = words, tokens, pairs, triples

    def plain(self) -> tuple:
        return self.words.store.path, np.diff(self.words.first).tolist(), self.tokens, self.pairs and self.pairs.plain(), self.triples and self.triples.plain()

    @staticmethod
    def of(path: str, sizes: list[int], tokens: int, pairs: tuple | None, triples: tuple | None) -> Trie:
        store = Store(path)
        return Trie(Vocabulary(store, sizes), tokens, pairs and Level(store, *pairs), triples and Level(store, *triples))

    def pairs_in(self, lengths: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each token the number of its pair among the batch's sorted distinct pairs; of these first token, place, code, weight; the tokens after a known pair."""
        width = U(self.words.size + 1)
        _, first, where = np.unique(v.astype(U) * width + w.astype(U), return_index=True, return_inverse=True)
        place, code, weight = self.pairs.look(v[first], w[first])
        after = place[where[:-1]] >= 0
        after[starts_of(lengths)[1:] - 1] = False
        return where, first, place, code, weight, np.flatnonzero(after) + 1

    def scores(self, lengths: np.ndarray, v: np.ndarray, w: np.ndarray, p_w: np.ndarray) -> np.ndarray:
        """log10 p of each token after the two before it; p_w: log10 p(w)."""
        where, first, place, code, weight, some = self.pairs_in(lengths, v, w)
        two = np.where(np.isfinite(code), code, weight + p_w[first])[where]
        if not len(some):
            return two
        # places of pairs ascend with their numbers
        width = U(self.words.size + 1)
        keys, where = np.unique(where[some - 1].astype(U) * width + w[some].astype(U), return_inverse=True)
        _, code, weight = self.triples.look(place[(keys // width).astype(np.int64)], (keys % width).astype(np.int64))
        two[some] = np.log10((10**code)[where] + (10**weight)[where] * 10 ** two[some])
        return two


def train(docs: DataFrame, path: str, ranges: int | None = None) -> Trie:
    """Counts the training documents and writes the levels under path; ranges: of each level, else by size."""
    spark, store = docs.sparkSession, Store(path)
    shared.small_batches(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    one = ranges or max(16, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_A_RANGE)

    def count_words(batches):
        for _, _, prints in batches_of(batches, True):
            keys, counts = np.unique(prints, return_counts=True)
            yield sent(keys, counts, np.searchsorted(range_of(keys, one), np.arange(one + 1)))
        shared.release()

    def level_one(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merged(pdf)
        r = int(pdf["range"].iloc[0])
        store.write(f"words{r}", encode((keys >> U(8)) - U(start_of(r, one)), start_of(r + 1, one) - start_of(r, one)) | {"counts": counts})
        return pd.DataFrame({"range": [r], "n": [len(keys)], "tokens": [int(counts.sum())]})

    def sizes_of(counter, writer, n: int) -> tuple[list[int], int]:
        """Runs a level. Its sizes are pinned as a table, so that the ranges are written once, whatever reads them."""
        told, parts = docs.mapInArrow(counter, "range int, keys binary, counts binary"), 1 + (trie.tokens if trie else 0) // TOKENS_A_PART
        if parts > 1:  # what many batches tell of a frequent context is merged in parts first, so that no task gets it from all of them
            told = told.groupBy("range", F.pmod(F.xxhash64("keys"), F.lit(parts))).applyInPandas(part_merged, "range int, keys binary, counts binary")
        done, _ = shared.stored(told.groupBy("range").applyInPandas(writer, "range int, n long, tokens long"), "sizes")
        sizes, tokens = [0] * n, 0
        for r, k, t in done.collect():
            sizes[r], tokens = k, tokens + t
        return sizes, tokens

    trie = None
    sizes, tokens = sizes_of(count_words, level_one, one)
    trie = Trie(Vocabulary(store, sizes), tokens)
    size, many = trie.words.size, ranges or max(16, tokens // TOKENS_A_RANGE)
    width = size + 1

    def totals(keys: np.ndarray, counts: np.ndarray, contexts: int) -> tuple[np.ndarray, ...]:
        """Context and word of each entry, successors of each context, its weight, and of each entry the discounted share."""
        v, w = (keys // U(width)).astype(np.int64), (keys % U(width)).astype(np.int64)
        total, kinds = np.bincount(v, counts, contexts), np.bincount(v, minlength=contexts)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(total > 0, DISCOUNT * kinds / total, 1.0)
        return v, w, kinds, weight, (counts - DISCOUNT) / total[v]

    # there are size + 2 contexts of pairs: words, the start, and unknown words
    bounds = even(size + 2, many)
    plain = trie.plain()

    def count_pairs(batches):
        known = Trie.of(*plain)
        for _, lengths, prints in batches_of(batches, True):
            v, w, _ = words_in(known.words, lengths, prints)
            keys, counts = np.unique(v.astype(U) * U(width) + w.astype(U), return_counts=True)
            ends = np.searchsorted((keys // U(width)).astype(np.int64), bounds)
            for r in range(many):
                keys[ends[r] : ends[r + 1]] -= U(bounds[r]) * U(width)
            yield sent(keys, counts, ends)
        shared.release()

    def level_two(pdf: pd.DataFrame) -> pd.DataFrame:
        known = Trie.of(*plain).words
        keys, counts = merged(pdf)
        r = int(pdf["range"].iloc[0])
        v, w, kinds, weight, share = totals(keys, counts, bounds[r + 1] - bounds[r])
        numbers, where = np.unique(w, return_inverse=True)
        c_w = np.empty(len(numbers), np.int64)
        ends = np.searchsorted(numbers, known.first)
        for k in range(known.n):
            if ends[k] < ends[k + 1]:
                c_w[ends[k] : ends[k + 1]] = known.of(k)[1][numbers[ends[k] : ends[k + 1]] - known.first[k]]
        p_w = 10 ** log_p(c_w, tokens, size)[where]
        Level(store, "pairs", width, bounds, [0] * many).write(r, keys, np.log10(share + weight[v] * p_w), kinds, np.log10(weight))
        shared.release()
        return pd.DataFrame({"range": [r], "n": [len(keys)], "tokens": [int(counts.sum())]})

    trie.pairs = Level(store, "pairs", width, bounds, sizes_of(count_pairs, level_two, many)[0])
    thirds = even(int(trie.pairs.firsts[-1]), many)
    paired = trie.plain()

    def count_triples(batches):
        known = Trie.of(*paired)
        for _, lengths, prints in batches_of(batches, True):
            v, w, _ = words_in(known.words, lengths, prints)
            where, _, place, _, _, some = known.pairs_in(lengths, v, w)
            keys, counts = np.unique(where[some - 1].astype(U) * U(width) + w[some].astype(U), return_counts=True)
            before = place[(keys // U(width)).astype(np.int64)]  # ascends with the keys
            ends = np.searchsorted(before, thirds)
            base = np.repeat(thirds[:-1], np.diff(ends))
            yield sent((before - base).astype(U) * U(width) + keys % U(width), counts, ends)
        shared.release()

    def level_three(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merged(pdf)
        r = int(pdf["range"].iloc[0])
        _, _, kinds, weight, share = totals(keys, counts, thirds[r + 1] - thirds[r])
        Level(store, "triples", width, thirds, [0] * many).write(r, keys, np.log10(share), kinds, np.log10(weight))
        shared.release()
        return pd.DataFrame({"range": [r], "n": [len(keys)], "tokens": [int(counts.sum())]})

    trie.triples = Level(store, "triples", width, thirds, sizes_of(count_triples, level_three, many)[0])
    return trie


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; where documents are read, no shuffle."""
    shared.small_batches(docs.sparkSession)
    plain, tokens, size = trie.plain(), trie.tokens, trie.words.size
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa

        model = Trie.of(*plain)
        for ids, lengths, prints in batches_of(batches, False):
            v, w, c = words_in(model.words, lengths, prints)
            base = log_p(c, tokens, size)
            found, at = model.scores(lengths, v, w, base), starts_of(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow_kind), pa.array([not training(i) for i in ids]), pa.array(lengths, pa.int64()), pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), pa.array(np.full(len(ids), tokens), pa.int64()), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(found, at))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
        shared.release()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(docs.schema["doc_id"].dataType)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return score(docs, train(docs, shared.new_path(spark, "trie")))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """The same model with dictionaries and no quantisation, for tests: held_out, n_tokens, n_known, N, base_score, score."""
    from collections import Counter

    tokens = {d: [*(t or "").encode().lower().split(), END] for d, t in rows}
    c, grams, total, kinds = Counter(), Counter(), Counter(), Counter()
    for d, _ in rows:
        if training(d):
            ws = tokens[d]
            c.update(ws)
            grams.update(zip([None, *ws], ws))
            grams.update(zip([None, *ws], ws, ws[1:]))
    for g, n in grams.items():
        total[g[:-1]] += n
        kinds[g[:-1]] += 1
    big_n, big_v, out = sum(c.values()), len(c), {}
    p = lambda w: (c[w] + 0.1) / (big_n + 0.1 * (big_v + 1))
    for d, ws in tokens.items():
        base = sum(math.log10(p(w)) for w in ws)
        s = 0.0
        for i, w in enumerate(ws):
            q = p(w)
            for context in ((ws[i - 1] if i else None,), ([None, *ws][i - 1], ws[i - 1]) if i else ()):
                if context and total[context]:
                    q = max(grams[*context, w] - DISCOUNT, 0) / total[context] + DISCOUNT * kinds[context] / total[context] * q
            s += math.log10(q)
        out[d] = (not training(d), len(ws), sum(c[w] > 0 for w in ws), big_n, base, s)
    return out


QUERIES = {"op7_lm_score": op7_lm_score}
ORACLES: dict[str, str] = {}
