"""An FM-index over a sequence of symbols: suffix order, wavelet-matrix ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np

#: Every so many positions of the sequence are stored; others are reached from them by steps to the left.
SAMPLED = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in lexicographic order; each 0 counts as a symbol of its own, in order of place.

    Prefix doubling: what is told apart by its first symbols is not sorted again, so that only repeats cost further
    rounds, and a repeat ends at a 0.
    """
    n = len(symbols)
    ends = symbols == 0
    n_ends = int(ends.sum())
    first = np.where(ends, np.cumsum(ends), symbols.astype(np.int64) + n_ends)
    base = int(first.max(initial=0)) + 1
    width = max(1, 62 // max(1, base.bit_length()))
    key = first.copy()
    for k in range(1, width):
        key *= base
        key[: max(0, n - k)] += first[k:]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    heads = np.ones(n, bool)
    heads[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    # rows of order whose suffixes are not told apart from a neighbour's
    open_ = np.flatnonzero(~heads | np.append(~heads[1:], False))
    while len(open_):
        starts = order[open_]
        after = starts + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[starts]
        place = np.argsort(group * (n + 1) + second, kind="stable")
        starts, group, second = starts[place], group[place], second[place]
        order[open_] = starts
        new = np.ones(len(open_), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        rank[starts] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        open_ = open_[~new | np.append(~new[1:], False)]
        width *= 2
    return order


class Bits:
    """Bits packed in words of 64, with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one level of bits for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, (n_symbols - 1).bit_length()) - 1, -1, -1):
            bits = (sequence >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bits), len(bits) - int(bits.sum())))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])
        self.first = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbols >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbols, at) - self.first[symbols]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbols = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            one = bits[at]
            ones = bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
            symbols |= one.astype(np.int64) << shift
        return symbols, at - self.first[symbols]


class FMIndex:
    """Occurrences of patterns in a sequence of symbols below n_symbols, whose parts each end with a 0."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sampled: int = SAMPLED):
        order = suffix_array(symbols)
        self.size = len(symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        # what stands before the first suffix is read by nobody, as its position is stored
        self.left = WaveletMatrix(symbols[order - 1].astype(np.int64), n_symbols)
        stored = np.arange(self.size) % sampled == 0
        stored[1:] |= symbols[:-1] == 0
        stored = stored[order]
        self.stored, self.positions = Bits(stored), order[stored]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the patterns (rows of symbols above 0) that occur, and their rows of the suffix order: first, end."""
        which = np.arange(len(patterns))
        if not patterns.size:
            return which[:0], which[:0], which[:0]
        last = patterns[:, -1]
        low, high = self.below[last], self.below[last + 1]
        for column in range(patterns.shape[1] - 2, -2, -1):
            some = high > low
            which, low, high = which[some], low[some], high[some]
            if column < 0 or not len(which):
                break
            symbol = patterns[which, column]
            ranks = self.left.rank(np.tile(symbol, 2), np.concatenate([low, high]))
            low, high = np.split(np.tile(self.below[symbol], 2) + ranks, 2)
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of rows of the suffix order."""
        found = np.empty(len(rows), np.int64)
        walking, steps = np.arange(len(rows)), 0
        while len(walking):
            here = self.stored[rows]
            found[walking[here]] = self.positions[self.stored.rank(rows[here])] + steps
            walking, rows = walking[~here], rows[~here]
            symbol, rank = self.left.symbol_and_rank(rows)
            rows = self.below[symbol] + rank
            steps += 1
        return found
