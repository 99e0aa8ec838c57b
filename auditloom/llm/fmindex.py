"""A compressed FM-index over integer sequences, searched for many patterns at once.

The Burrows-Wheeler transform of a shard is kept as a wavelet matrix: one bit vector per
bit of a symbol, packed into 64-bit words with a running count per word. Suffixes are
ordered by their first ``depth`` symbols only, which is all that patterns of at most
``depth`` symbols can see.
"""

from __future__ import annotations

import numpy as np


_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.zeros(len(counts), np.int32)
        np.cumsum(counts[:-1], out=self.before[1:])
        self.ones = int(counts.sum())

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _BELOW[at & 63])


class WaveletMatrix:
    """Rank of any symbol in a sequence over ``0 .. 2**levels - 1``."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels = levels
        self.bits: list[Bits] = []
        for level in range(levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(np.uint8)
            self.bits.append(Bits(bit))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

        # where each symbol's positions begin after the last level
        every = np.arange(1 << levels)
        self.begin = self._descend(every, [np.zeros(len(every), np.int64)])[0]

    def _descend(self, symbol: np.ndarray, ats: list[np.ndarray]) -> list[np.ndarray]:
        for level, bits in zip(range(self.levels - 1, -1, -1), self.bits, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            zeros = bits.n - bits.ones
            moved = [bits.rank1(x) for x in ats]
            ats = [np.where(one, zeros + r, x - r) for r, x in zip(moved, ats, strict=True)]
        return ats

    def rank(self, symbol: np.ndarray, *ats: np.ndarray) -> list[np.ndarray]:
        """Occurrences of each symbol before each of the given positions."""
        begin = self.begin[symbol]
        return [x - begin for x in self._descend(symbol, list(ats))]


def _dense(keys: np.ndarray) -> np.ndarray:
    """Rank of every key among the distinct keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def truncated_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes sorted by at least their first ``depth`` symbols, by prefix doubling.

    Also gives, for some lengths (1 among them), the rank of every position's run of so
    many symbols, by which longer runs can be compared.
    """
    n = len(text)
    ranks = {1: text.astype(np.int64)}
    bits = max(1, int(text.max(initial=0)).bit_length())
    have = max(1, min(depth, 62 // bits))
    key = np.zeros(n, np.int64)
    for j in range(have):
        key <<= bits
        key[: n - j] |= ranks[1][j:]
    rank = ranks[have] = _dense(key)
    while have < depth:
        follow = np.zeros(n, np.int64)
        follow[: max(n - have, 0)] = rank[have:] + 1
        rank = _dense(rank * (n + 1) + follow)
        have *= 2
        ranks[have] = rank
    return np.argsort(rank, kind="stable"), ranks


class FMIndex:
    """Index of one text of symbols >= 1 in which every sequence ends with a 0.

    ``width`` is the length of the windows that are searched for. For each class of equal
    windows the index keeps the smallest text position at which it starts.
    """

    def __init__(self, text: np.ndarray, width: int) -> None:
        n = len(text)
        self.width = width
        self.sigma = int(text.max(initial=0)) + 1
        order, ranks = truncated_order(text, width)
        last = text[order - 1]  # position 0 is preceded by the closing 0 of the text
        self.counts = np.zeros(self.sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=self.sigma), out=self.counts[1:])
        self.bwt = WaveletMatrix(last.astype(np.int64), max(1, int(self.sigma - 1).bit_length()))
        # where neighbours in the order share fewer than width - 1, or width, symbols
        same = self._shared(ranks, order, width - 1)
        self.short_starts = np.flatnonzero(~same)
        self.short_of = np.cumsum(~same) - 1
        self.short_ends = np.append(self.short_starts[1:], n)
        starts = np.flatnonzero(~self._shared(ranks, order, width))
        classes = np.zeros(n, np.int64)
        classes[starts] = 1
        self.earliest = np.minimum.reduceat(order, starts)[np.cumsum(classes) - 1]

    @staticmethod
    def _shared(ranks: dict[int, np.ndarray], order: np.ndarray, length: int) -> np.ndarray:
        """Whether each suffix in the order shares ``length`` symbols with the one before."""
        n = len(order)
        out = np.ones(n, bool)
        out[0] = False
        a, b, done = order[:-1], order[1:], 0
        while done < length:
            part = max(x for x in ranks if x <= length - done)
            x, y = np.minimum(a + done, n - 1), np.minimum(b + done, n - 1)
            out[1:] &= ranks[part][x] == ranks[part][y]
            done += part
        return out

    def step(self, symbol, low, high):
        """Intervals of the patterns that have one more symbol in front."""
        a, b = self.bwt.rank(symbol, low, high)
        first = self.counts[symbol]
        return first + a, first + b

    def statistics(self, text: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        """Matching statistics of the sequences ``text[begin:end]``, from right to left.

        All sequences advance together by one symbol a round. A match that has reached
        ``width`` symbols is shortened at its right end before the next symbol is put in
        front; one that cannot be extended loses its last symbol and is searched again. Yields ``(position, low)`` of the
        windows of ``width`` symbols that occur in the index: their place in ``text`` and
        the first row of their interval.
        """
        at = ends.astype(np.int64) - 1
        begins = begins.astype(np.int64)
        low = np.zeros(len(at), np.int64)
        high = np.full(len(at), self.bwt.bits[0].n, np.int64)
        length = np.zeros(len(at), np.int64)
        live = np.flatnonzero(at >= begins)
        while len(live):
            a, b = low[live], high[live]
            full = length[live] >= self.width
            group = self.short_of[a[full]]
            a[full], b[full] = self.short_starts[group], self.short_ends[group]
            size = np.minimum(length[live], self.width - 1)
            symbol = text[at[live]]
            known = (symbol > 0) & (symbol < self.sigma)
            symbol = np.where(known, symbol, 0)
            known &= self.counts[symbol + 1] > self.counts[symbol]
            na, nb = self.step(symbol, a, b)
            lost = ~known | (na >= nb)
            low[live] = np.where(lost, 0, na)
            high[live] = np.where(lost, self.bwt.bits[0].n, nb)
            length[live] = np.where(lost, 0, size + 1)
            # no match holds a symbol the index lacks; otherwise drop the last symbol and search again
            again = lost & known
            at[live[again]] += size[again]
            hit = live[length[live] >= self.width]
            if len(hit):
                yield at[hit], low[hit]
            at[live] -= 1
            live = live[at[live] >= begins[live]]
