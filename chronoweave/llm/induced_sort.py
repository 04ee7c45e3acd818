"""Suffixes of many byte strings in order, with capped common prefixes, by induced sorting.

The strings stand side by side, each ended by character 0, which is never equal to another 0. Suffixes smaller
than their successor are S, the others L; the S ones after an L are seeds. Sorted seeds induce the order of all L
suffixes, read by rising character, and these that of all S suffixes, read by falling character. Seeds are sorted
by inducing once from their characters alone, naming the pieces between seeds, and sorting the string of names,
half as long at most, in the same way.

What is induced waits in one queue per character. Keys never fall below the one being read, so the queues together
are a priority queue of (character, arrival) -> (position, common prefix with the one before); past ``limit`` bytes
they are written to a scratch file of the task, as Spark's own spills are. A common prefix is one more than the
least common prefix read since the last arrival at the same character. Those of the seeds, where induction starts,
are counted on the text.

Characters with few suffixes each (names at deeper levels) go through plain lists, of at most half the
positions; characters with many go through the queues at every level.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

_REC = np.dtype([("pos", "<i8"), ("lcp", "u1")])
#: Suffixes a character from which whole arrays are quicker than single steps.
_DENSE = 400


class Queues:
    """First-in first-out queues of records, one per character, spilled to disk past ``limit`` bytes."""

    def __init__(self, limit: int):
        self.parts: dict[int, list] = {}
        self.limit, self.held, self.file = limit, 0, None

    def push(self, c: int, rec: np.ndarray) -> None:
        self.parts.setdefault(c, []).append(rec)
        self.held += rec.nbytes
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts.values():
            for k, rec in enumerate(parts):
                if isinstance(rec, np.ndarray):
                    parts[k] = (self.file.tell(), len(rec))
                    self.file.write(rec.tobytes())
        self.held = 0

    def _load(self, part) -> np.ndarray:
        if isinstance(part, np.ndarray):
            return part
        self.file.seek(part[0])
        return np.frombuffer(self.file.read(part[1] * _REC.itemsize), dtype=_REC)

    def read(self, c: int) -> Iterator[np.ndarray]:
        """Records of c in order of arrival, those that arrive meanwhile included; they leave the queue."""
        k, parts = 0, self.parts.get(c, [])
        while k < len(parts):
            rec, part = self._load(parts[k]), parts[k]
            parts[k] = (0, 0)
            self.held -= part.nbytes if isinstance(part, np.ndarray) else 0
            k += 1
            yield rec
        self.parts.pop(c, None)


def range_min(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of x[first] to x[last], last included."""
    out = np.empty(len(first), dtype=x.dtype)
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    step = 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(x[first[at]], x[last[at] - step + 1])
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return out


class _Emitter:
    """Hands the predecessors of what is read, of one type, to their characters' queues."""

    def __init__(self, text, is_s, want_s: bool, cap: int, limit: int):
        self.text, self.is_s, self.want_s, self.cap = text, is_s, want_s, cap
        self.queues = Queues(limit)
        top = int(text.max(initial=0)) + 1
        self.since, self.seen = np.zeros(top, dtype=np.uint8), np.zeros(top, dtype=bool)

    def read(self, rec: np.ndarray) -> None:
        if not len(rec):
            return
        before = rec["pos"] - 1  # -1 is the last 0, which is never wanted
        c = self.text[before]
        k = np.flatnonzero((self.is_s[before] == self.want_s) & (c > 0))
        k = k[np.argsort(c[k], kind="stable")]
        c = c[k].astype(np.int64)
        out = np.zeros(len(k), dtype=_REC)
        out["pos"] = before[k]
        new = np.ones(len(k), dtype=bool)
        new[1:] = c[1:] != c[:-1]
        lead = np.flatnonzero(new)
        if self.cap:
            lcp = rec["lcp"].copy()
            back = np.zeros(len(k), dtype=np.int64)
            back[1:] = k[:-1] + 1
            back[lead] = 0
            least = range_min(lcp, back, k)
            least[lead] = np.minimum(least[lead], self.since[c[lead]])
            least = np.minimum(least, self.cap - 1) + 1
            least[lead[~self.seen[c[lead]]]] = 0
            out["lcp"] = least
            rest = np.full(len(lcp) + 1, 255, dtype=np.uint8)
            rest[:-1] = np.minimum.accumulate(lcp[::-1])[::-1]
            np.minimum(self.since, rest[0], out=self.since)
            last = np.append(lead[1:], len(k)) - 1 if len(k) else lead
            self.since[c[last]] = rest[k[last] + 1]
            self.seen[c[lead]] = True
        for x, part in zip(c[lead].tolist(), np.split(out, lead[1:])):
            self.queues.push(x, part)


def types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(S or not, length of the run of equal characters) of every position."""
    at = np.arange(len(text))
    other = np.where(np.append(text[1:] != text[:-1], True), at, len(text))
    other = np.minimum.accumulate(other[::-1])[::-1]
    rises = text[np.minimum(other + 1, len(text) - 1)] > text
    return rises | (text == 0), other - at + 1


def induce(text, is_s, run, seeds: np.ndarray, cap: int, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(character, L suffixes rising, S suffixes falling) by falling character, from (ordered) seeds."""
    chars = text[seeds["pos"]].astype(np.int64)
    used = np.unique(text).tolist()
    cut = np.searchsorted(chars, used)
    own = dict(zip(used, np.split(seeds, cut[1:])))
    up, down, rising = _Emitter(text, is_s, False, cap, limit), _Emitter(text, is_s, True, cap, limit), Queues(limit)
    for c in used:
        last = None
        for rec in up.queues.read(c):
            up.read(rec)
            rising.push(c, rec)
            last = rec["pos"][-1]
        rec = own[c].copy()
        if cap and len(rec):
            rec["lcp"][0] = 0 if last is None else min(run[last], run[rec["pos"][0]], cap)
        up.read(rec)
    none = np.zeros(0, dtype=_REC)
    for c in reversed(used[1:]):
        falling = []
        for rec in down.queues.read(c):
            down.read(rec)
            falling.append(rec)
        small, large = np.concatenate([none, *rising.read(c)]), np.concatenate([none, *falling])
        rec = small[::-1].copy()
        if cap and len(rec):
            rec["lcp"][1:] = small["lcp"][:0:-1]
            rec["lcp"][0] = min(run[rec["pos"][0]], run[large["pos"][-1]], cap) if len(large) else 0
        down.read(rec)
        yield c, small, large


def _induce_singly(text, is_s, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L suffixes, S suffixes), each rising and 0 left out, by single steps: for large alphabets."""
    chars, s = text.tolist(), is_s.tolist()
    low: list[list] = [[] for _ in range(max(chars) + 1)]
    high: list[list] = [[] for _ in low]
    own: list[list] = [[] for _ in low]
    for i in seeds["pos"].tolist():
        own[chars[i]].append(i)
    for c, waiting in enumerate(low):
        for part in (waiting, own[c]):
            for i in part:  # grows while it is read
                if not s[i - 1]:
                    low[chars[i - 1]].append(i - 1)
    for c in range(len(high) - 1, 0, -1):
        for part in (high[c], reversed(low[c])):
            for i in part:
                if s[i - 1] and chars[i - 1]:
                    high[chars[i - 1]].append(i - 1)
    return np.array([i for part in low for i in part], dtype=np.int64), np.array([i for part in high for i in reversed(part)], dtype=np.int64)


def _records(pos: np.ndarray) -> np.ndarray:
    rec = np.zeros(len(pos), dtype=_REC)
    rec["pos"] = pos
    return rec


def _sorted_s(text, is_s, run, seeds, limit: int) -> np.ndarray:
    if len(text) < _DENSE * (int(text.max()) + 1):
        return _induce_singly(text, is_s, seeds)[1]
    parts = [large["pos"][::-1] for _, _, large in induce(text, is_s, run, seeds, 0, limit)]
    return np.concatenate([np.zeros(0, dtype=np.int64), *parts[::-1]])


def _names(text: np.ndarray, order: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the pieces [order, stop], which are in order; equal ones share a rank."""
    new = np.ones(len(order), dtype=bool)
    size = stop - order + 1
    alike = np.flatnonzero(size[1:] == size[:-1])
    for k in range(int(size[alike].max(initial=0))):
        alike = alike[text[order[alike] + k] == text[order[alike + 1] + k]]
        done = size[alike] == k + 1
        new[alike[done] + 1] = False
        alike = alike[~done]
        if not len(alike):
            break
    return np.cumsum(new)


def sorted_seeds(text: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(types, runs, seeds in the order of their suffixes, the 0s first)."""
    is_s, run = types(text)
    zero = text == 0
    seed = zero.copy()
    seed[1:] |= is_s[1:] & ~is_s[:-1]
    at = np.flatnonzero(seed)
    by_char = at[np.argsort(text[at], kind="stable")]
    order = _sorted_s(text, is_s, run, _records(by_char), limit)
    order = order[seed[order]]
    place = np.searchsorted(at, order)
    name = _names(text, order, at[np.minimum(place + 1, len(at) - 1)])
    zeros = np.flatnonzero(zero)
    if len(order) and name[-1] < len(order):
        short = np.zeros(len(at), dtype=np.int64)
        short[place] = name
        order = at[_sorted_suffixes(short, limit)]
    return is_s, run, np.concatenate((zeros, order))


def _sorted_suffixes(text: np.ndarray, limit: int) -> np.ndarray:
    """All suffixes of ``text`` in order, those that start with 0 left out."""
    is_s, run, seeds = sorted_seeds(text, limit)
    rec = _records(seeds)
    if len(text) < _DENSE * (int(text.max()) + 1):
        both = np.concatenate(_induce_singly(text, is_s, rec))  # within a character, L before S
        return both[np.argsort(text[both], kind="stable")]
    parts = [np.concatenate((small["pos"], large["pos"][::-1])) for _, small, large in induce(text, is_s, run, rec, 0, limit)]
    return np.concatenate([np.zeros(0, dtype=np.int64), *parts[::-1]])


def seed_prefixes(text: np.ndarray, seeds: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix, ``cap`` at most, of each seed with the one before, counted on the text."""
    left = np.flatnonzero(text == 0)
    left = left[np.searchsorted(left, seeds)] - seeds
    most = np.minimum(np.minimum(left[1:], left[:-1]), cap)
    wide = np.zeros(len(text) + cap + 4, dtype=np.uint64)
    wide[: len(text)] = text
    wide = wide[:-3] | wide[1:-2] << np.uint64(16) | wide[2:-1] << np.uint64(32) | wide[3:] << np.uint64(48)
    out = np.zeros(len(seeds), dtype=np.int64)
    alive = np.arange(len(most))
    for k in range(0, cap, 4):
        alive = alive[most[alive] > k]
        differ = wide[seeds[alive] + k] ^ wide[seeds[alive + 1] + k]
        same = differ == 0
        part = differ[~same]
        low = (np.frexp((part & (~part + np.uint64(1))).astype(np.float64))[1] - 1) // 16
        out[alive[~same] + 1] = k + low
        alive = alive[same]
        out[alive + 1] = k + 4
    out[1:] = np.minimum(out[1:], most)
    return out.astype(np.uint8)


def equal_prefixes(text: np.ndarray, length: int, limit: int = 256 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, groups): suffixes of ``text`` by groups of two or more that share their first ``length`` characters.

    ``text``: bytes plus 1, each string ended by 0 and none empty; ``length`` from 1 to 250.
    """
    if not len(text):
        return
    is_s, run, seeds = sorted_seeds(text, limit)
    rec = _records(seeds)
    rec["lcp"] = seed_prefixes(text, seeds, length)
    for _, small, large in induce(text, is_s, run, rec, length, limit):
        pos = np.concatenate((small["pos"], large["pos"][::-1]))
        lcp = np.concatenate((small["lcp"], np.zeros(len(large), dtype=np.uint8)))
        if len(large):
            lcp[len(small) + 1 :] = large["lcp"][:0:-1]
            if len(small):
                lcp[len(small)] = min(run[small["pos"][-1]], run[large["pos"][-1]], length)
        joined = lcp >= length
        member = joined.copy()
        member[:-1] |= joined[1:]
        group = np.cumsum(~joined)
        if member.any():
            yield pos[member], group[member]
