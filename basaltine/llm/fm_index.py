"""An FM-index over word ids: suffix array, wavelet matrix ranks, sampled suffix positions.

A text is an int array in which 0 separates runs; separators differ from each other and sort
before all words. All queries take and return arrays, so a step is one pass over all patterns.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; each turn sorts only suffixes that still tie."""
    n = len(text)
    gaps = text == 0
    count = int(gaps.sum())
    first = text.astype(np.int64) + count
    first[gaps] = np.arange(1, count + 1)
    base = int(first.max(initial=0)) + 1
    width = max(1, min(8, int(62 / max(1, np.log2(max(base, 2))))))
    key = np.zeros(n, np.int64)
    for j in range(width):
        key *= base
        if j < n:
            key[: n - j] += first[j:]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    key = key[order]
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = starts
    while True:
        single = new.copy()
        single[:-1] &= new[1:]
        slots = np.flatnonzero(~single)
        if not len(slots):
            return order
        part = order[slots]
        after = np.zeros(len(part), np.int64)
        inside = part + width < n
        after[inside] = rank[part[inside] + width] + 1
        key = rank[part] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        part, key = part[by], key[by]
        order[slots] = part
        fresh = np.ones(len(part), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[slots] = fresh
        rank[part] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(part)), 0))]
        width *= 2


class Bits:
    """A bit vector with ranks: 64-bit words and the count of ones before each."""

    def __init__(self, bits: np.ndarray):
        raw = np.zeros(-(-(len(bits) + 1) // 64) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        raw[: len(packed)] = packed
        self.word = raw.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.word), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.word[w] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.word[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """A wavelet matrix: a level for each bit of a symbol, zeros stably before ones."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels, x = [], symbols
        self.bits = range(max(1, int(largest).bit_length()) - 1, -1, -1)
        for b in self.bits:
            one = (x >> b) & 1 != 0
            self.levels.append((Bits(one), len(x) - int(one.sum())))
            x = np.concatenate([x[~one], x[one]])
        self.first = self._walk(np.arange(largest + 1), np.zeros(largest + 1, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, (bits, zeros) in zip(self.bits, self.levels, strict=True):
            ones = bits.rank(at)
            at = np.where((symbol >> b) & 1 != 0, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._walk(symbol, at) - self.first[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions, and how often each stands before."""
        symbol = np.zeros(len(at), np.int64)
        for b, (bits, zeros) in zip(self.bits, self.levels, strict=True):
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << b
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.first[symbol]


class FMIndex:
    """Backward search and location over a text of word ids up to ``largest``."""

    def __init__(self, text: np.ndarray, largest: int, sample: int = 16):
        order = suffix_array(text)
        last = text[order - 1]  # of the suffix at 0 the final separator
        self.size = len(text)
        self.wavelet = Wavelet(last, largest)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        # A walk never crosses a separator: the first place of every run is sampled.
        kept = (order % sample == 0) | (last == 0)
        self.sampled, self.places = Bits(kept), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern; patterns are left-aligned rows of ids > 0."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for step in range(int(lengths.max(initial=0))):
            alive = alive[(lengths[alive] > step)]
            todo = alive[low[alive] < high[alive]]
            if not len(todo):
                break
            c = patterns[todo, lengths[todo] - 1 - step]
            low[todo] = self.before[c] + self.wavelet.rank(c, low[todo])
            high[todo] = self.before[c] + self.wavelet.rank(c, high[todo])
            alive = todo
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of suffix rows, walking back to the nearest sample."""
        out, at, todo, steps = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            known = self.sampled.get(at)
            out[todo[known]] = self.places[self.sampled.rank(at[known])] + steps
            todo, at = todo[~known], at[~known]
            if len(todo):
                symbol, nth = self.wavelet.access(at)
                at = self.before[symbol] + nth
                steps += 1
        return out
