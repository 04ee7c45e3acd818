"""Longest common extensions of positions of an integer string, from a difference cover.

The nine powers of two modulo 73 are a difference cover: every difference modulo 73 is the difference of two of
them. So any two positions reach, after the same number (72 at most) of steps, two positions whose remainders are
in the cover. Only suffixes at such positions are sorted: by their first 73 characters, then by prefix doubling,
each round on those that are still tied. Common prefixes of neighbours in that order, with a sparse table of
minima, answer for sampled positions; a query compares characters until it reaches them, and most end before.

The string must consist of pieces, each ended by a character that occurs nowhere else; so no extension passes a
piece's end. Memory is about 9 / 73 of the positions times (rounds of doubling + levels of the table) * 4 bytes.
"""

from __future__ import annotations

import numpy as np

MODULUS = 73
COVER = sorted(pow(2, k, MODULUS) for k in range(9))

_SLOT = np.zeros(MODULUS, dtype=np.int64)
_SLOT[COVER] = np.arange(len(COVER))
#: By difference d: the member a of the cover such that a + d is one, too.
_FIRST = np.zeros(MODULUS, dtype=np.int64)
for _a in COVER:
    for _b in COVER:
        _FIRST[(_b - _a) % MODULUS] = _a


def _split_groups(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order the tied suffixes of each rank by ``key``; sets their ranks, returns those that stay tied.

    The rank of a suffix is the place of the first of its group, so a group's places are known before it is split.
    """
    order = np.lexsort((key, rank[tied]))
    tied, key = tied[order], key[order]
    old = rank[tied]
    at = np.arange(len(tied))
    new_group = np.ones(len(tied), dtype=bool)
    new_group[1:] = old[1:] != old[:-1]
    new = new_group.copy()
    new[1:] |= key[1:] != key[:-1]
    group_start = np.maximum.accumulate(np.where(new_group, at, 0))
    start = np.maximum.accumulate(np.where(new, at, 0))
    rank[tied] = old + (start - group_start)
    size = np.diff(np.append(np.flatnonzero(new), len(tied)))
    return tied[np.repeat(size, size) > 1]


class DifferenceCoverLce:
    """``extension(i, j)`` for arrays of positions of ``text`` (integers from 0)."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.text = np.concatenate((text.astype(np.int64), np.zeros(MODULUS, dtype=np.int64)))
        self.sampled = (np.arange(0, n + MODULUS, MODULUS)[:, None] + np.array(COVER)).ravel()
        self.sampled = self.sampled[self.sampled < n]
        self._sort()
        self._neighbours()

    def _sort(self) -> None:
        """``levels[k]``: ranks by the first 73 * 2**k characters; equal exactly where these are equal."""
        at, m = self.sampled, len(self.sampled)
        bits = max(1, int(self.text.max(initial=0)).bit_length())
        width = max(1, 63 // bits)
        rank, tied = np.zeros(m, dtype=np.int64), np.arange(m)
        for k in range(0, MODULUS, width):
            if len(tied) < 2:
                break
            key = np.zeros(len(tied), dtype=np.int64)
            for c in range(k, min(k + width, MODULUS)):
                key = key << bits | self.text[at[tied] + c]
            tied = _split_groups(rank, tied, key)
        self.levels, step = [rank.astype(np.int32)], len(COVER)
        while len(tied):
            before = self.levels[-1]
            tied = _split_groups(rank, tied, before[tied + step])
            self.levels.append(rank.astype(np.int32))
            step *= 2
        self.rank = rank

    def _neighbours(self) -> None:
        """Common prefixes of neighbours in the order, and the sparse table of their minima."""
        m = len(self.sampled)
        order = np.empty(m, dtype=np.int64)
        order[self.rank] = np.arange(m)
        x, y = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(m - 1, 0), dtype=np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            level, inside = self.levels[k], np.maximum(x, y) < m
            same = inside.copy()
            same[inside] = level[x[inside]] == level[y[inside]]
            x[same] += len(COVER) << k
            y[same] += len(COVER) << k
            common[same] += MODULUS << k
        left, right = self.sampled[order[:-1]] + common, self.sampled[order[1:]] + common
        common += self._compare(left, right, np.full(len(common), MODULUS))
        self.table = [common.astype(np.int32)]
        while 2 << (len(self.table) - 1) <= len(common):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal characters from i and j on, ``most`` at most."""
        out = np.zeros(len(i), dtype=np.int64)
        alive = np.flatnonzero(most > 0)
        step = 0
        while len(alive):
            alive = alive[self.text[i[alive] + step] == self.text[j[alive] + step]]
            step += 1
            out[alive] = step
            alive = alive[most[alive] > step]
        return out

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and at j; i and j differ."""
        reach = (_FIRST[(j - i) % MODULUS] - i) % MODULUS
        out = self._compare(i, j, reach)
        open_ = np.flatnonzero(out == reach)
        at_i, at_j = i[open_] + reach[open_], j[open_] + reach[open_]
        x = self.rank[at_i // MODULUS * len(COVER) + _SLOT[at_i % MODULUS]]
        y = self.rank[at_j // MODULUS * len(COVER) + _SLOT[at_j % MODULUS]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            pick = level == k
            row = self.table[k]
            out[open_[pick]] += np.minimum(row[low[pick]], row[high[pick] - (1 << k)])
        return out
