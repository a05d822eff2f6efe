"""A compressed FM-index over integer texts: wavelet tree of packed bits, backward search for many patterns at once."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """A bit vector in 64-bit words with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        word = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """A balanced wavelet tree, level by level: at each level the nodes stand side by side."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.n, self.bits = len(values), []
        now = values
        for level in range(self.levels - 1, -1, -1):
            self.bits.append(Bits((now >> level & 1).astype(np.uint8)))
            now = now[np.argsort(now >> level, kind="stable")]
        # where each node of the next level starts: rows of smaller prefixes
        counts = np.bincount(values, minlength=1 << self.levels)
        self.starts = np.concatenate([[0], np.cumsum(counts)])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each pair, how often the symbol occurs among the first `at` values."""
        at = at.astype(np.int64)
        for k, bits in enumerate(self.bits):
            level = self.levels - 1 - k
            node = self.starts[symbols >> (level + 1) << (level + 1)]
            ones = bits.rank(node + at) - bits.rank(node)
            at = np.where(symbols >> level & 1, ones, at - ones)
        return at


class FMIndex:
    """Suffixes of `text` (values from 1; 0 separates) sorted by their first `depth` symbols or more.

    Patterns of up to `depth` symbols are counted and located exactly; order
    beyond that depth does not matter for them.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n, self.depth = len(text), depth
        rank = text.astype(np.int64)
        done = 1
        while True:
            following = np.zeros(n, np.int64)
            if done < n:
                following[: n - done] = rank[done:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + following
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            done *= 2
            if done >= depth or rank[order[-1]] == n - 1:
                break
        self.suffixes = order
        sigma = int(text.max(initial=0)) + 1
        bwt = text[order - 1]  # the text is read as a circle; separators keep patterns from crossing its end
        self.tree = WaveletTree(bwt, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.shorter = self._classes(text, depth - 1)
        same = self._classes(text, depth)
        self.earliest = np.minimum.reduceat(order, same[0])[same[1]] if n else order

    def _classes(self, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows grouped by the first `length` symbols: each class's first row, each row's class."""
        n, new = len(text), np.zeros(len(text), bool)
        if n:
            new[0] = True
        a, b = self.suffixes[1:], self.suffixes[:-1]
        live = np.arange(n - 1)
        for k in range(length):
            # a suffix that meets the end or a separator is a class of its own extent there
            differ = text[(a[live] + k) % n] != text[(b[live] + k) % n] if n else live
            new[1:][live[differ]] = True
            live = live[~differ]
        return np.flatnonzero(new), np.cumsum(new) - 1

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: intervals of the patterns with `symbols` put in front."""
        base = self.first[symbols]
        return base + self.tree.rank(symbols, lo), base + self.tree.rank(symbols, hi)

    def shorten(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns of `depth` symbols at `lo` without their last symbol."""
        starts, of = self.shorter
        k = of[lo]
        ends = np.append(starts[1:], len(of))
        return starts[k], ends[k]


def matching_statistics(index: FMIndex, text: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Streams pieces of words (piece i is text[ends[i]-lengths[i] : ends[i]]) backwards through the index, all at once.

    Returns, for every position of `text`, the length of the longest match that
    starts there (up to the index's depth, within the piece) and the smallest
    text position at which the match of full depth occurs (-1 if shorter). A
    piece's words must all occur in the index.
    """
    n, depth = len(index.suffixes), index.depth
    matched, earliest = np.zeros(len(text), np.int32), np.full(len(text), -1, np.int64)
    lo, hi, have = np.zeros(len(ends), np.int64), np.full(len(ends), n, np.int64), np.zeros(len(ends), np.int64)
    for step in range(1, int(lengths.max(initial=0)) + 1):
        live = np.flatnonzero(lengths >= step)
        full = live[have[live] == depth]
        lo[full], hi[full] = index.shorten(lo[full])
        have[full] -= 1
        at = ends[live] - step
        a, b = index.extend(text[at], lo[live], hi[live])
        lost = a >= b
        if lost.any():
            # only a piece that is not in the index gets here: start again at this word
            c = text[at][lost]
            a[lost], b[lost] = index.first[c], index.first[c + 1]
            have[live[lost]] = 0
        lo[live], hi[live] = a, b
        have[live] += 1
        matched[at] = have[live]
        whole = have[live] == depth
        earliest[at[whole]] = index.earliest[a[whole]]
    return matched, earliest
