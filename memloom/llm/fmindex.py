"""A compressed FM-index over a sequence of numbers: a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


class PackedBits:
    """A bit sequence, 64 to a word, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        inside = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)


class FMIndex:
    """Backward search for many patterns of at most ``depth`` symbols at once.

    Suffixes are sorted by their first ``depth`` symbols, which is all that such patterns need.
    The symbol 0 separates the parts of the text; patterns don't contain it.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.suffixes = self._sort(text, depth)
        last = text[self.suffixes - 1].astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1))])
        self.levels: list[PackedBits] = []
        self.bits = max(1, int(text.max(initial=0)).bit_length())
        for b in range(self.bits - 1, -1, -1):
            bit = (last >> b) & 1
            self.levels.append(PackedBits(bit))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        self.size = n

    @staticmethod
    def _sort(text: np.ndarray, depth: int) -> np.ndarray:
        """Suffixes by their first symbols, by doubling the length that is ranked."""
        n, rank, size = len(text), text.astype(np.int64), 1
        while size < depth:
            after = np.zeros(n, np.int64)
            after[: n - size] = rank[size:] + 1 if size < n else 0
            pair = rank * (int(rank.max(initial=0)) + 2) + after
            _, rank = np.unique(pair, return_inverse=True)
            size *= 2
        return np.argsort(rank, kind="stable").astype(np.int32)

    def _occurrences(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transformed text before each place."""
        begin = np.zeros(len(at), np.int64)
        for b, level in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = ((symbol >> b) & 1).astype(bool)
            o_at, o_begin = level.ones(at), level.ones(begin)
            at = np.where(one, level.zeros + o_at, at - o_at)
            begin = np.where(one, level.zeros + o_begin, begin - o_begin)
        return at - begin

    def search(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For patterns of ``length`` that end (exclusive) at places of ``text``: suffix intervals.

        These are the matching statistics cut at ``length``: a pattern is followed backwards while
        something other than itself matches; one that comes down to a single suffix ends there.
        """
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        active = np.arange(len(ends))
        for k in range(1, length + 1):
            symbol = text[ends[active] - k]
            a = self.starts[symbol] + self._occurrences(symbol, low[active])
            b = self.starts[symbol] + self._occurrences(symbol, high[active])
            low[active], high[active] = a, b
            active = active[b - a > 1]
            if not len(active):
                break
        return low, high
