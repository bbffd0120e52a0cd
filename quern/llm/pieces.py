"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch that are not known yet are laid end to end and indexed by a suffix array, sorted as deep as the
longest piece. Every piece is searched for in it at once: its range is narrowed character by character. The ranges are
the edges of all words; sorted by position they are relaxed from left to right. In a BPE model the last piece before
a position is the one whose pair with the last piece before its own start stays apart when the two are merged alone; there is
exactly one, so one pass gives the same pieces as merging in order of score. Characters without a piece become their bytes.

Words are cut where no piece reaches across: before a space mark that follows another character, around line ends, and between
a letter and a mark that no piece holds side by side. The model file is a parameter and is read on the driver; its vocabulary (bounded) goes to the workers with the task.

Null and empty texts have no pieces; decoding gives an empty text for both. Very long texts are cut into words, and words of any
length are indexed whole. The text's own U+2581 means a space, as in the format, and comes back as one, so round_trip is false there.
Models that this method can't express (unigram models, normalisers) are refused: the library's pieces of PROBES must be the same.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import shared

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Texts that a normaliser or another kind of model would treat in its own way.
PROBES = ("the  tokenisation of internationalisation", " two leading", "trailing ", "ﬁ Ａ Å é ½", "a\tb\nc", "12345678 9999", "Straße übergrößer naïve", "aaaaaaaaaaaaaaaa", "don't re-enter")
#: Letters and marks between which texts are cut where no piece holds the two side by side.
LETTERS = "".join(c for c in map(chr, range(65, 0x180)) if c.isalpha())
MARKS = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
#: Words that a worker remembers, and characters that one suffix array indexes (a longer word is indexed alone).
REMEMBERED = 300_000
INDEXED = 150_000
#: Slots for pairs of pieces, a power of two.
PAIRS = 1 << 20


class Model:
    """The vocabulary of a BPE model with byte fallback, as plain data."""

    def __init__(self, raw: bytes) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = p.get_piece_size()
        special = [p.is_byte(i) or p.is_control(i) or p.is_unknown(i) for i in range(n)]
        self.text = [p.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.piece = {self.text[i]: i for i in range(n) if not special[i]}
        self.score = {i: p.get_score(i) for i in self.piece.values()}
        self.unknown = p.unk_id()
        self.crossing = any("\n" in t and len(t) > 1 or SPACE in t.lstrip(SPACE) for t in self.piece)
        if self.crossing:
            raise ValueError("pieces reach across words")
        self.probed = [p.encode(t) for t in PROBES]

    def check(self) -> None:
        """Refuses a model of another kind."""
        offsets, ids = Encoder(self).encode(list(PROBES))
        if [ids[a:z].tolist() for a, z in zip(offsets[:-1], offsets[1:], strict=True)] != self.probed:
            raise ValueError("not a BPE model without normaliser")


class Rows:
    """A 32-bit array that grows at its end."""

    def __init__(self) -> None:
        self.held, self.size = np.zeros(1024, np.int32), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.held):
            self.held = np.concatenate((self.held[: self.size], np.zeros(max(len(more), self.size // 2 + 1024), np.int32)))
        self.held[self.size : self.size + len(more)] = more
        self.size += len(more)


class Encoder:
    def __init__(self, model: Model) -> None:
        self.m = model
        order = sorted(model.piece)
        self.ids = np.array([model.piece[t] for t in order], np.int64)
        self.sizes = np.array([len(t) for t in order], np.int64)
        self.depth = int(self.sizes.max())
        self.codes = np.zeros((len(order), self.depth), np.int64)
        for i, t in enumerate(order):
            self.codes[i, : len(t)] = [ord(c) for c in t]
        beside = {(t[i], t[i + 1]) for t in model.piece for i in range(len(t) - 1)}
        marks = re.escape("".join(m for m in MARKS if not any((c, m) in beside for c in LETTERS)))
        rest = rf"(?:[^{SPACE}\n{marks}]|(?<![{LETTERS}])[{marks}])*" if marks else rf"[^{SPACE}\n]*"
        self.words = re.compile(rf"{SPACE}+{rest}|[^{SPACE}\n]{rest}|\n")
        # what is known of pairs, the last met of each slot, by first * vocabulary + second
        self.pair_key, self.pair_ok = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.width = len(model.text)
        self.alone = np.zeros(len(model.text), bool)
        for t, i in model.piece.items():
            self.alone[i] = self.merged(t) == [t]
        self.plain = [b""] * len(model.text)
        for t, i in model.piece.items():
            self.plain[i] = t.replace(SPACE, " ").encode()
        for b, i in model.byte.items():
            self.plain[i] = bytes([b])
        self.plain_size = np.array([len(x) for x in self.plain], np.int32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.count, self.flat = Rows(), Rows(), Rows()

    def merged(self, text: str) -> list[str]:
        """Plain merging by score, leftmost first; for pieces and pairs, which are short."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                if (k := self.m.piece.get(parts[i] + parts[i + 1])) is not None and (best is None or self.m.score[k] > best[0]):
                    best = (self.m.score[k], i)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]

    def apart(self, a: int, b: int) -> bool:
        x, y = self.m.text[a], self.m.text[b]
        return self.merged(x + y) == [x, y]

    def suffix_array(self, codes: np.ndarray) -> np.ndarray:
        """Suffixes sorted by their first `depth` characters: as many as fit in 63 bits at once, then by doubling."""
        kinds, rank = np.unique(codes, return_inverse=True)
        bits = int(len(kinds)).bit_length()
        h = max(1, 63 // bits)
        key, n = np.zeros(len(codes), np.int64), len(codes)
        for i in range(h):
            key <<= bits
            key[: max(0, n - i)] |= rank[i:] + 1
        while True:
            order = np.argsort(key)  # equal suffixes in any order
            line = key[order]
            new = np.cumsum(np.concatenate(([0], line[1:] != line[:-1])))
            if h >= self.depth or new[-1] == n - 1:
                return order
            rank = np.empty(n, np.int64)
            rank[order] = new
            key = rank * (int(new[-1]) + 2)
            key[: max(0, n - h)] += rank[h:] + 1
            h *= 2

    def ranges(self, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's occurrences begin and end in the suffix array, all pieces at once."""
        padded = np.concatenate((codes, np.full(self.depth, -1)))
        lo, hi = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), len(order), np.int64)
        for k in range(self.depth):
            live = np.flatnonzero((self.sizes > k) & (lo < hi))
            if not len(live):
                break
            want, bounds = self.codes[live, k], []
            for right in (False, True):
                a, z = lo[live].copy(), hi[live].copy()
                while (open_ := np.flatnonzero(a < z)).size:
                    mid = (a[open_] + z[open_]) >> 1
                    c = padded[order[mid] + k]
                    less = c <= want[open_] if right else c < want[open_]
                    a[open_] = np.where(less, mid + 1, a[open_])
                    z[open_] = np.where(less, z[open_], mid)
                bounds.append(a)
            lo[live], hi[live] = bounds
        return lo, hi

    def stay(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether piece p stays apart from the piece q before it; q below 0: nothing stands there."""
        key = q.astype(np.int64) * self.width + p
        slot = (shared.mix(key.astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
        ok = np.where(q < 0, self.alone[p], self.pair_ok[slot])
        new = np.flatnonzero((self.pair_key[slot] != key) & (q >= 0))
        if len(new):
            distinct, first, where = np.unique(key[new], return_index=True, return_inverse=True)
            found = np.array([self.apart(int(a), int(b)) for a, b in zip(q[new][first], p[new][first], strict=True)])
            self.pair_key[slot[new][first]], self.pair_ok[slot[new][first]] = distinct, found
            ok[new] = found[where]
        return ok

    def relaxed(self, begin: np.ndarray, piece: np.ndarray, stops: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last piece before each position (-1: a character without one) and where it begins: position by position, in all words at once."""
        n = int(starts[-1] + lengths[-1]) + 2
        last, origin = np.full(n, -1, np.int32), np.arange(-1, n - 1, dtype=np.int32)
        order = np.argsort(-lengths, kind="stable")
        starts, many = starts[order], np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max()) + 1), "right")
        for e, m in enumerate(many.tolist(), 1):  # the m words of e characters and more
            at = starts[:m] + e
            k, until = stops[at - 1], stops[at]
            while True:
                some = k < until
                at, k, until = at[some], k[some], until[some]
                if not len(at):
                    break
                ok = self.stay(last[begin[k]], piece[k])
                last[at[ok]], origin[at[ok]] = piece[k[ok]], begin[k[ok]]
                at, k, until = at[~ok], k[~ok] + 1, until[~ok]
        return last, origin

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not known yet and remembers them."""
        while words:
            total, n = 0, 0
            while n < len(words) and (not n or total + len(words[n]) <= INDEXED):
                total += len(words[n]) + 1
                n += 1
            self.index(words[:n])
            words = words[n:]

    def index(self, words: list[str]) -> None:
        joined = "\x00".join(words) + "\x00"  # no piece holds the separator
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        bounds = np.cumsum([len(w) + 1 for w in words]).tolist()
        order = self.suffix_array(codes)
        lo, hi = self.ranges(codes, order)
        n = hi - lo
        begin = order[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))]
        size, piece = np.repeat(self.sizes, n), np.repeat(self.ids, n)
        by_end = np.argsort((begin + size) * (self.depth + 1) + (self.depth - size))  # by end, longest first
        begin, size, piece = begin[by_end], size[by_end], piece[by_end]
        stops = np.searchsorted(begin + size, np.arange(1, len(codes) + 2))  # edges that end at position e: stops[e-1] to stops[e]
        bounds = np.array(bounds)
        starts = np.concatenate(([0], bounds[:-1]))
        last, origin = self.relaxed(begin, piece, stops, starts, bounds - starts - 1)
        text, byte, unknown = joined, self.m.byte, self.m.unknown
        flat, counts, last, origin = array("i"), [], array("i", last.tobytes()), array("i", origin.tobytes())
        for start, stop in zip(starts.tolist(), bounds.tolist(), strict=True):
            out, e = [], stop - 1
            while e > start:
                if last[e] >= 0:
                    out.append(last[e])
                else:
                    out += [byte.get(b, unknown) for b in reversed(text[e - 1].encode())]
                e = origin[e]
            out.reverse()
            flat.extend(out)
            counts.append(len(out))
        known = len(self.known)
        self.known.update(zip(words, range(known, known + len(words)), strict=True))
        counts = np.array(counts, np.int64)
        self.first.add(self.flat.size + np.concatenate(([0], np.cumsum(counts)[:-1])))
        self.count.add(counts)
        self.flat.add(np.frombuffer(flat, np.int32))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the pieces of text i are ids[offsets[i]:offsets[i + 1]]."""
        if len(self.known) > REMEMBERED:
            self.forget()
        words = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        n = np.array([len(ws) for ws in words], np.int64)
        words = list(chain.from_iterable(words))
        index = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(index < 0).tolist()
        if new:
            self.learn(list({words[i] for i in new}))
            index[new] = [self.known[words[i]] for i in new]
        count = self.count.held[index]
        ends = np.cumsum(count, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat.held[np.repeat(self.first.held[index] - (ends - count), count) + np.arange(total)]
        return np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n)))], ids

    def comes_back(self, offsets: np.ndarray, ids: np.ndarray, raws: list[bytes]) -> list[bool]:
        """Whether decoding gives each text's bytes back."""
        joined = b"".join(map(self.plain.__getitem__, ids.tolist()))
        ends = np.concatenate(([0], np.cumsum(self.plain_size[ids], dtype=np.int64)))[offsets].tolist()
        return [joined[a:z] == (b" " + raw if raw else b"") for a, z, raw in zip(ends[:-1], ends[1:], raws, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text: pieces and bytes joined, without the leading space that encoding adds."""
        raw = b"".join(map(self.plain.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


#: The encoder of a worker's last model, by its digest: what it has learnt of pairs serves the next tasks.
ENCODERS: dict[str, Encoder] = {}


def encoder_for(spark: SparkSession, path: str = MODEL):
    with open(path, "rb") as f:
        raw = f.read()
    Model(raw).check()
    sent, digest = spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()

    def get() -> Encoder:
        if digest not in ENCODERS:
            ENCODERS.clear()
            ENCODERS[digest] = Encoder(Model(sent.value))
        return ENCODERS[digest]

    return get


#: Bytes of text encoded at once.
HELD = 1 << 20


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, round_trip (decoding gives the text back). One pass, no shuffle."""
    shared.small_batches(docs.sparkSession)
    get, kind = encoder_for(docs.sparkSession, path), dict(docs.dtypes)["doc_id"]

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        import pyarrow as pa

        encoder = get()

        def done(ids: list, texts: list, raws: list):
            offsets, found = encoder.encode(texts)
            same = encoder.comes_back(offsets, found, raws)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(ids, arrow_kind), pa.array(np.diff(offsets), pa.int64()), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"])

        ids, texts, raws, size = [], [], [], 0
        for batch in batches:
            for doc, t, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shared.as_bytes(batch.column(1)), strict=True):
                ids.append(doc)
                texts.append(t)
                raws.append(raw)
                size += len(raw)
                if size >= HELD:
                    yield done(ids, texts, raws)
                    ids, texts, raws, size = [], [], [], 0
        if ids:
            yield done(ids, texts, raws)
        encoder.forget()
        shared.release()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows of doc_id, ids; null ids give a null text."""
    shared.small_batches(rows.sparkSession)
    get, kind = encoder_for(rows.sparkSession, path), dict(rows.dtypes)["doc_id"]

    def of(batch):
        return {"doc_id": batch.column(0), "text": [None if x is None else get().decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]}

    return shared.arrow_map(rows.select("doc_id", "ids"), of, f"doc_id {kind}, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(shared.table(spark, sf_dir, "documents"))


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLES: dict[str, str] = {}
