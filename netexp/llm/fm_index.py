"""FM-index of a shard of texts over words: count and locate phrases without the texts.

A shard is a sequence of symbols, 0 at the end of each text and 1, 2, ... for
its words. The index keeps its Burrows-Wheeler transform as a wavelet matrix
(one bit vector a bit of the symbols, with ranks by popcount) and, for every
eighth position and every start of a text, the position itself at its place in
suffix order. All operations work on whole arrays of phrases or places.
"""

from __future__ import annotations

import numpy as np

#: Positions are kept at multiples of this and at starts of texts: a walk takes fewer steps than that.
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. Ends of texts come first and differ from each other, so that no comparison goes past one.

    The first sort takes as many symbols as fit in 63 bits; then only suffixes
    that are still tied are sorted, by twice as many symbols in each round.
    """
    n = len(symbols)
    ends = symbols == 0
    k = int(ends.sum())
    rank = symbols.astype(np.int64) + (k - 1)
    rank[ends] = np.arange(k)
    bits = max(int(rank.max()).bit_length(), 1)
    h = max(63 // bits, 1)
    key, ahead = rank.copy(), np.concatenate((rank, np.zeros(h, np.int64)))
    for j in range(1, h):
        key = key << bits | ahead[j : j + n]
    order = np.argsort(key)
    key = key[order]
    places = tied = np.arange(n)
    at = order
    while True:
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, places[: len(key)], 0))
        rank[at] = tied[first]
        alone = new.copy()
        alone[:-1] &= new[1:]
        tied = tied[~alone]
        if not len(tied):
            return order
        at = order[tied]
        # equal in h symbols, so no end of text among them: at + h is inside
        key = rank[at] * n + rank[at + h]
        turn = np.argsort(key)
        key, at = key[turn], at[turn]
        order[tied] = at
        h *= 2


class Bits:
    """Rows of bit vectors of one length with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts, axis=1) - counts

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        """A vector of booleans as 64-bit words, with a spare one, so that a rank may be asked at the end."""
        words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        return words

    def rank(self, row: int, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        at, rest = i >> 6, (i & 63).astype(np.uint64)
        return self.before[row][at] + np.bitwise_count(self.words[row][at] & ((np.uint64(1) << rest) - np.uint64(1)))

    def get(self, row: int, i: np.ndarray) -> np.ndarray:
        return (self.words[row][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    """counts: symbols by value; levels: the wavelet matrix, high bits first; marks, samples: kept positions in suffix order."""

    def __init__(self, counts: np.ndarray, levels: np.ndarray, marks: np.ndarray, samples: np.ndarray):
        self.n, self.depth = int(counts.sum()), len(levels)
        self.counts, self.samples = counts.astype(np.int64), samples
        self.levels, self.marks = Bits(levels), Bits(marks.reshape(1, -1))
        self.less = np.cumsum(self.counts) - self.counts
        self.zeros = [self.n - int(np.bitwise_count(row).sum()) for row in levels]
        # where a symbol's run begins below the last level: symbols in order of their reversed bits
        reverse = np.zeros(len(counts), dtype=np.int64)
        value = np.arange(len(counts))
        for b in range(self.depth):
            reverse |= (value >> b & 1) << (self.depth - 1 - b)
        turn = np.argsort(reverse)
        self.run = np.zeros(len(counts), dtype=np.int64)
        self.run[turn] = np.cumsum(self.counts[turn]) - self.counts[turn]

    @classmethod
    def build(cls, symbols: np.ndarray) -> FMIndex:
        """Of symbols that end with 0."""
        order = suffix_order(symbols)
        starts = np.zeros(len(symbols), dtype=bool)
        starts[0] = True
        starts[1:] = symbols[:-1] == 0
        kept = (order % SAMPLE == 0) | starts[order]
        counts = np.bincount(symbols)
        depth = max(int(len(counts) - 1).bit_length(), 1)
        left, levels = symbols[order - 1], []
        for b in range(depth - 1, -1, -1):
            bit = (left >> b & 1).astype(bool)
            levels.append(Bits.pack(bit))
            left = np.concatenate((left[~bit], left[bit]))
        return cls(counts, np.stack(levels), Bits.pack(kept), order[kept].astype(np.int32))

    def parts(self) -> tuple[bytes, bytes, bytes, bytes]:
        """The index as four byte strings; ``load`` reads them."""
        return self.counts.astype(np.int32).tobytes(), self.levels.words.tobytes(), self.marks.words.tobytes(), self.samples.tobytes()

    @classmethod
    def load(cls, counts: bytes, levels: bytes, marks: bytes, samples: bytes) -> FMIndex:
        marks_, bits = np.frombuffer(marks, dtype=np.uint64), np.frombuffer(levels, dtype=np.uint64)
        return cls(np.frombuffer(counts, dtype=np.int32), bits.reshape(-1, len(marks_)), marks_, np.frombuffer(samples, dtype=np.int32))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands before place i of the transform."""
        for level in range(self.depth):
            ones = self.levels.rank(level, i)
            i = np.where(symbol >> (self.depth - 1 - level) & 1, self.zeros[level] + ones, i - ones)
        return i - self.run[symbol]

    def ranges(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes that begin with each phrase, as ranges [from, to) of the order. Phrases are rows of symbols, aligned to the right."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for step in range(phrases.shape[1]):
            go = np.flatnonzero((length > step) & (lo < hi))
            if not len(go):
                break
            symbol = phrases[go, -1 - step].astype(np.int64)
            both = self.rank(np.concatenate((symbol, symbol)), np.concatenate((lo[go], hi[go])))
            lo[go], hi[go] = self.less[symbol] + both[: len(go)], self.less[symbol] + both[len(go) :]
        return lo, hi

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Positions of suffixes from their places in the order: steps to the left up to a kept position."""
        out, left, where = np.zeros(len(places), np.int64), np.arange(len(places)), places
        step = 0
        while len(left):
            kept = self.marks.get(0, where)
            out[left[kept]] = self.samples[self.marks.rank(0, where[kept])] + step
            left, i = left[~kept], where[~kept]
            symbol = np.zeros(len(i), np.int64)
            for level in range(self.depth):
                bit, ones = self.levels.get(level, i), self.levels.rank(level, i)
                symbol = symbol << 1 | bit
                i = np.where(bit, self.zeros[level] + ones, i - ones)
            where = self.less[symbol] + i - self.run[symbol]
            step += 1
        return out
