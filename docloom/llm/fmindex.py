"""FM-index over byte codes: suffix array, wavelet matrix, backward search and located occurrences.

Everything works on whole arrays: all patterns of a length take a step of the backward search at once,
all occurrences walk to their next sampled position at once.
"""

from __future__ import annotations

import numpy as np

#: one text position in so many is sampled
SAMPLE = 8
#: positions of a shard; keys of the suffix sort pack two ranks and a position into 64 bits
MOST = 1 << 21


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of ``s`` (uint8, less than MOST) in the order of their suffixes, by prefix doubling.

    A round sorts only suffixes that are not told apart yet.
    """
    n = len(s)
    if n >= MOST:
        raise ValueError("shard too long")
    if not n:
        return np.zeros(0, np.int64)
    shift, mask = np.uint64(21), np.uint64(MOST - 1)
    pad = np.concatenate((s.astype(np.uint64) + np.uint64(1), np.zeros(4, np.uint64)))  # 0: past the end
    key = pad[:n]
    for k in range(1, 4):
        key = key << np.uint64(9) | pad[k : k + n]
    key = np.sort(key << shift | np.arange(n, dtype=np.uint64))
    sa = (key & mask).astype(np.int64)
    new = np.concatenate(([True], (key[1:] >> shift) != (key[:-1] >> shift)))
    rank = np.zeros(n + 1, np.int64)  # rank[n]: the end, before all
    group = np.flatnonzero(new)
    rank[sa] = np.repeat(group, np.diff(np.append(group, n))) + 1
    k = 4
    while True:
        single = new & np.append(new[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            return sa
        at = sa[slots]
        second = rank[np.minimum(at + k, n)]
        key = np.sort(rank[at].astype(np.uint64) << np.uint64(42) | second.astype(np.uint64) << shift | at.astype(np.uint64))
        at = (key & mask).astype(np.int64)
        sa[slots] = at
        differs = np.concatenate(([True], (key[1:] >> shift) != (key[:-1] >> shift)))
        new[slots] |= differs
        head = np.flatnonzero(differs)
        rank[at] = np.repeat(slots[head], np.diff(np.append(head, len(slots)))) + 1
        k *= 2


class BitRank:
    """Ones before each position of a bit array, in blocks of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, i: np.ndarray) -> np.ndarray:
        block, rest = i >> 6, (i & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << rest) - np.uint64(1)))


class WaveletMatrix:
    """rank(c, i): how often byte ``c`` occurs before position ``i``."""

    def __init__(self, s: np.ndarray) -> None:
        self.levels: list[tuple[BitRank, int]] = []
        cur = s
        for bit in range(7, -1, -1):
            b = (cur >> bit) & 1
            ones = b.astype(bool)
            self.levels.append((BitRank(b), int(len(b) - ones.sum())))
            cur = np.concatenate((cur[~ones], cur[ones]))
        zero = np.zeros(256, np.int64)
        self.begin = self._walk(np.arange(256), zero)

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, (rank, zeros) in zip(range(7, -1, -1), self.levels):
            ones = rank.ones(i)
            i = np.where((c >> bit) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(c, i) - self.begin[c]


class FmIndex:
    """Index of one shard; code 0 parts its texts and is in no pattern."""

    def __init__(self, s: np.ndarray) -> None:
        s = np.append(s, np.uint8(0))  # the shard's end
        self.n = len(s)
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        self.wavelet = WaveletMatrix(self.bwt)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=256))))
        sampled = (sa % SAMPLE == 0) | (self.bwt == 0)  # the begin of each text too: no walk leaves its text
        self.marked = BitRank(sampled.astype(np.uint8))
        self.positions = sa[sampled]
        self.is_marked = sampled

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of patterns (one a row), last code first."""
        m, k = patterns.shape
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for j in range(k - 1, -1, -1):
            c = patterns[live, j].astype(np.int64)
            both = self.wavelet.rank(np.concatenate((c, c)), np.concatenate((low[live], high[live])))
            low[live], high[live] = self.first[c] + both[: len(live)], self.first[c] + both[len(live) :]
            live = live[low[live] < high[live]]
            if not len(live):
                break
        gone = low >= high
        low[gone] = high[gone] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: steps back to the last sampled position."""
        out = np.zeros(len(rows), np.int64)
        todo, row, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            done = self.is_marked[row]
            hit = row[done]
            out[todo[done]] = self.positions[self.marked.ones(hit)] + steps
            todo, row = todo[~done], row[~done]
            c = self.bwt[row].astype(np.int64)
            row = self.first[c] + self.wavelet.rank(c, row)
            steps += 1
        return out
