"""An FM-index over a shard of short word sequences: the Burrows-Wheeler transform in a wavelet matrix of packed bits,
searched backward for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with a directory of the set bits before each 64."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)])
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)
        self.ones = int(bits.sum())
        self.zeros = n - self.ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.height, self.levels = max(1, int(sigma - 1).bit_length()), []
        rest = symbols
        for level in range(self.height - 1, -1, -1):
            bit = (rest >> level) & 1 > 0
            self.levels.append((level, Bits(bit)))
            rest = np.concatenate([rest[~bit], rest[bit]])
        every = np.arange(sigma)
        self.first = self._down(np.zeros(sigma, np.int64), every)

    def _down(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        for level, bits in self.levels:
            ones = bits.rank(at)
            at = np.where((symbols >> level) & 1 > 0, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._down(at, symbols) - self.first[symbols]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; needs a text whose suffixes all differ early (here: distinct terminators)."""
    n = len(text)
    rank, step = text.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[step:] + 1
        key = rank * (int(second.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        rank, step = new, step * 2
        if n == 0 or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Over sequences of words (uint64 hashes); sequences end in terminators that differ, so that none runs into the
    next. Words that occur once in the shard share a symbol: nothing that contains one can occur twice."""

    def __init__(self, sequences: list[np.ndarray]):
        m = len(sequences)
        lengths = np.array([len(s) for s in sequences], np.int64)
        words, ids, counts = np.unique(np.concatenate(sequences), return_inverse=True, return_counts=True)
        rare = counts < 2
        # symbols, 0 for terminators and 1 for words that occur once, must rise with the order of the suffixes
        dense = np.where(rare, 1, 1 + np.cumsum(~rare))
        ids = np.where(rare, np.cumsum(rare) - 1, rare.sum() + np.cumsum(~rare) - 1)[ids]
        self.ids = np.sort(dense)[ids]
        self.sigma = int(dense.max()) + 1
        ends = np.cumsum(lengths + 1) - 1
        text = np.empty(len(ids) + m, np.int64)
        inner = np.ones(len(text), bool)
        inner[ends] = False
        text[inner], text[ends] = ids + m, np.arange(m)
        order = suffix_array(text)
        symbols = np.zeros(len(text), np.int64)
        symbols[inner] = self.ids
        self.tree = WaveletMatrix(symbols[order - 1], self.sigma)
        self.less = np.searchsorted(symbols[order], np.arange(self.sigma))
        self.n = len(text)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that begin with symbol and then with what rows lo to hi begin with."""
        both = self.tree.rank(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        k = len(symbols)
        return self.less[symbols] + both[:k], self.less[symbols] + both[k:]


def repeated_spans(sequences: list[np.ndarray], least: int) -> list[list[tuple[int, int]]]:
    """For each sequence of a shard its maximal spans [a, b) of at least `least` words that occur more than once among
    all of them, found by backward search from the right: the matching statistics at the ends where a span may close.

    All sequences advance together, each by one word at a time. A search that stopped after a span of enough words
    goes on where the next span could end, else one word further left."""
    index = FMIndex(sequences)
    lengths = np.array([len(s) for s in sequences], np.int64)
    begin = np.cumsum(lengths) - lengths
    found: list[list[tuple[int, int]]] = [[] for _ in sequences]
    lane = np.flatnonzero(lengths >= least)
    end = lengths[lane]
    at, lo, hi = end.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), index.n, np.int64)
    while len(lane):
        symbols = index.ids[begin[lane] + np.maximum(at - 1, 0)]
        a, b = index.extend(symbols, lo, hi)
        go = (at > 0) & (symbols > 1) & (b - a > 1)
        lo, hi, at = np.where(go, a, lo), np.where(go, b, hi), np.where(go, at - 1, at)
        stop = np.flatnonzero(~go)
        if len(stop):
            size = end[stop] - at[stop]
            for i in stop[size >= least]:
                found[lane[i]].append((int(at[i]), int(end[i])))
            done = at[stop] == 0
            next_end = np.where(size >= least, at[stop] + least - 1, end[stop] - 1)
            next_end = np.where(symbols[stop] == 1, at[stop] - 1, next_end)  # no span has that word
            end[stop] = at[stop] = np.where(done, 0, next_end)
            lo[stop], hi[stop] = 0, index.n
            if (end[stop] < least).any():
                stay = np.ones(len(lane), bool)
                stay[stop] = end[stop] >= least
                lane, end, at, lo, hi = lane[stay], end[stay], at[stay], lo[stay], hi[stay]
    return found
