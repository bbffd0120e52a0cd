"""Elias-Fano sequences over numpy arrays that may be memory-mapped, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Zeros before each block of so many bits of the upper part are kept, for select.
BLOCK = 64
POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """A non-decreasing sequence of integers below universe as low (packed low bits), high (unary upper bits), zeros (directory), meta (n, low bits)."""
    n = len(values)
    bits = max(0, (int(universe) // max(n, 1)).bit_length() - 1)
    values = values.astype(U)
    high = (values >> U(bits)).astype(np.int64)
    top = int(universe >> bits) + 1
    size = (-(-(n + top + 1) // BLOCK) + 1) * BLOCK
    unary = np.zeros(size // 8, np.uint8)
    at = high + np.arange(n)
    np.bitwise_or.at(unary, at >> 3, (1 << (at & 7)).astype(np.uint8))
    ones = POP[unary].reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
    zeros = np.concatenate(([0], np.cumsum(BLOCK - ones))).astype(np.uint32 if size < 1 << 32 else np.int64)
    low = np.zeros((n * bits + 63) // 64 + 2, U)
    if bits and n:
        rest = values & U((1 << bits) - 1)
        start = np.arange(n, dtype=np.int64) * bits
        word, shift = start >> 6, (start & 63).astype(U)
        np.bitwise_or.at(low, word, rest << shift)
        over = (start & 63) + bits > 64
        np.bitwise_or.at(low, word[over] + 1, rest[over] >> (U(64) - shift[over]))
    return {"low": low, "high": unary, "zeros": zeros, "meta": np.array([n, bits], np.int64)}


EACH, HIGH = U(0x0101010101010101), U(0x8080808080808080)
#: Where the k-th one of a byte stands, at 8 * byte + k.
IN_BYTE = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.uint8).ravel()


def select_in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where the k-th one of each 64-bit word stands: counts of all its bytes at once, then a look at one byte."""
    s = x - ((x >> U(1)) & U(0x5555555555555555))
    s = (s & U(0x3333333333333333)) + ((s >> U(2)) & U(0x3333333333333333))
    s = ((s + (s >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * EACH  # ones up to each byte
    place = (((((k * EACH) | HIGH) - s) & HIGH) >> U(7)) * EACH >> U(56) << U(3)  # bytes whose sum is at most k
    place = np.minimum(place, U(56))
    rest = k - ((s << U(8)) >> place & U(255))
    return (place + IN_BYTE[((x >> place & U(255)) << U(3)) + np.minimum(rest, U(7))]).astype(np.int64)


class EliasFano:
    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.low, self.high, self.zeros = parts["low"], parts["high"], parts["zeros"]
        self.n, self.bits = (int(x) for x in parts["meta"])
        self.ones: np.ndarray | None = None

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        start = i.astype(np.int64) * self.bits
        word, shift = start >> 6, (start & 63).astype(U)
        out = self.low[word] >> shift
        over = (start & 63) + self.bits > 64
        out[over] |= self.low[word[over] + 1] << (U(64) - shift[over])
        return out & U((1 << self.bits) - 1)

    def select(self, k: np.ndarray, zero: bool) -> np.ndarray:
        """Positions in the upper bits of the k-th (from 0) zeros, or ones."""
        k = np.asarray(k, np.int64)
        if zero:
            before = self.zeros
        else:
            if self.ones is None:
                self.ones = np.arange(len(self.zeros)) * BLOCK - self.zeros
            before = self.ones
        block = np.searchsorted(before, k.astype(before.dtype), "right") - 1
        left = (k - before[block].astype(np.int64)).astype(U)
        words = self.high.view(U)
        word = words[np.minimum(block, len(words) - 1)]
        return block * BLOCK + select_in_word(~word if zero else word, left)

    def run(self, at: np.ndarray, h: np.ndarray) -> np.ndarray:
        """How many ones stand from each position on, up to the next zero, which is the h-th."""
        words = self.high.view(U)
        word, shift = at >> 6, (at & 63).astype(U)
        seen = words[np.minimum(word, len(words) - 1)] >> shift
        more = shift > 0
        seen[more] |= words[np.minimum(word[more] + 1, len(words) - 1)] << (U(64) - shift[more])
        rest = ~seen
        out = np.zeros(len(at), np.int64)
        some = rest != 0
        low = rest[some] & (~rest[some] + U(1))
        out[some] = np.log2(low.astype(np.float64)).astype(np.int64)
        full = np.flatnonzero(~some)
        if len(full):
            out[full] = self.select(h[full], True) - at[full]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        i = np.asarray(i, np.int64)
        out = np.empty(len(i), U)
        for a in range(0, len(i), 65536):
            part = i[a : a + 65536]
            out[a : a + 65536] = ((self.select(part, False) - part).astype(U) << U(self.bits)) | self.lows(part)
        return out

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Position of the first element equal to each x, or -1; begin and end: where each is looked for."""
        x = np.asarray(x, U)
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        for a in range(0, len(x), 65536):
            part = x[a : a + 65536]
            high = (part >> U(self.bits)).astype(np.int64)
            inside = high < int(self.zeros[-1]) - 1
            h = np.where(inside, high, 0)
            at = np.where(h > 0, self.select(np.maximum(h - 1, 0), True) + 1, 0)  # in the upper bits, after the h-th zero
            first = at - h
            stop = first + self.run(at, h)
            low = part & U((1 << self.bits) - 1) if self.bits else np.zeros(len(part), U)
            if begin is not None:
                first, stop = np.maximum(first, begin[a : a + 65536]), np.minimum(stop, end[a : a + 65536])
            lo, hi = first.copy(), np.maximum(first, stop)
            while (open_ := np.flatnonzero(lo < hi)).size:  # binary search among the elements with the same upper bits
                mid = (lo[open_] + hi[open_]) >> 1
                less = self.lows(mid) < low[open_]
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
            ok = np.flatnonzero(inside & (lo < stop))
            ok = ok[self.lows(lo[ok]) == low[ok]]
            out[a + ok] = lo[ok]
        return out
