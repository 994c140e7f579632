"""An FM-index over a sequence of small integers: count and locate patterns by backward search."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        words = -(-(len(bits) + 1) // 64)
        packed = np.zeros(words * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        self.before = np.zeros(words, np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        below = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & _ONE == 1


class WaveletMatrix:
    """Symbols by one bit a level, stably parted by it: rank of any symbol in as many steps as it has bits."""

    def __init__(self, symbols: np.ndarray, width: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(width - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit), len(bit) - int(np.count_nonzero(bit))))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        first = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            a, b = bits.rank(first), bits.rank(i)
            first, i = np.where(one, zeros + a, first - a), np.where(one, zeros + b, i - b)
        return i - first

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        first, symbol = np.zeros_like(i), np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = bits.get(i)
            a, b = bits.rank(first), bits.rank(i)
            first, i = np.where(one, zeros + a, first - a), np.where(one, zeros + b, i - b)
            symbol |= one.astype(np.int64) << shift
        return symbol, i - first


def suffix_array(symbols: np.ndarray, width: int) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling; the end sorts before every symbol.

    The first order is by as many symbols as fit 62 bits. Later rounds touch only suffixes that still tie.
    """
    n = len(symbols)
    depth = max(1, 62 // (width + 1))
    key = np.zeros(n, np.int64)
    shifted = symbols.astype(np.int64) + 1
    for k in range(depth):
        key <<= width + 1
        key[: n - k] |= shifted[k:] if k < n else 0
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    del key, shifted
    rank = np.zeros(n + 1, np.int64)  # 1 + the first row of those that tie; 0 past the end
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, n))
    rank[order] = np.repeat(first + 1, sizes)
    rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(rows):
        at = order[rows]
        own = rank[at]
        key = own << 32 | rank[np.minimum(at + depth, n)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[rows] = at  # ties own consecutive rows, so their order among themselves is all that changes
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(rows)))
        rank[at] = np.repeat(rows[first] + 1, sizes)
        rows = rows[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return order


class FMIndex:
    """Symbols are 1 to `largest`; 0 is kept for the end. Positions are kept for every `sampling`-th suffix."""

    def __init__(self, symbols: np.ndarray, largest: int, sampling: int = 16) -> None:
        width = int(largest).bit_length()
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(text, width)
        self.size = len(text)
        self.wavelet = WaveletMatrix(text[order - 1], width)
        self.smaller = np.zeros(largest + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=largest + 1), out=self.smaller[1:])
        kept = order % sampling == 0
        self.kept, self.positions = Bits(kept), order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of patterns of one length (a row each): those found, and the rows [low, high) of their suffixes."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[which, column].astype(np.int64)
            base = self.smaller[symbol]
            low, high = base + self.wavelet.rank(symbol, low), base + self.wavelet.rank(symbol, high)
            some = low < high
            which, low, high = which[some], low[some], high[some]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back through the text until a row whose position is kept."""
        found, walked = np.zeros(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            here = self.kept.get(rows)
            found[left[here]] = self.positions[self.kept.rank(rows[here])] + walked
            left, rows = left[~here], rows[~here]
            symbol, rank = self.wavelet.step(rows)
            rows = self.smaller[symbol] + rank
            walked += 1
        return found
