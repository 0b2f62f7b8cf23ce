"""Suffix and common-prefix arrays of one shard by external induced sorting.

Level 0 is the shard's text; every level classifies its suffixes (L: larger than the next
one, S: smaller, S*: an S after an L), names the S* substrings, and orders the S* suffixes by
recursion on the string of names.  From the ordered S* suffixes all L suffixes are induced
in ascending order, and from those all S suffixes in descending order.

Induction runs on a priority queue keyed by the first symbol.  It is popped in bulk (all
entries of the least symbol, in the order they were induced), carries a suffix's position and
its common prefix with the entry before it, and moves to disk beyond a memory budget.
The common prefix of two suffixes induced into one bucket is one more than the least common
prefix met in the scan between them.  Arrays beyond the budget are memory-mapped files.
"""

from __future__ import annotations

import heapq
import os
import tempfile

import numpy as np

MEMORY_ROWS = 1 << 23       # entries a queue holds in memory; also when arrays go to disk
REDUCED_ROWS = 1 << 22      # names that are ordered in memory; a longer string of names recurses
_FAR = 255                  # no common prefix met yet


def spill_folder() -> str | None:
    """Where Spark puts this task's own spills (the executor's local folders); None outside a task."""
    named = os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or ""
    return next((d for d in named.split(",") if d and os.path.isdir(d)), None)


class Workspace:
    """Arrays that go to files of a temporary folder when large; the folder goes with the workspace.

    The files are a task's own spill, like Spark's: no other task reads them, and a task that is run again starts anew.
    """

    def __init__(self, memory_rows: int = MEMORY_ROWS, reduced_rows: int = REDUCED_ROWS):
        self.memory_rows, self.reduced_rows = memory_rows, reduced_rows
        self.folder: tempfile.TemporaryDirectory | None = None
        self.files = 0

    def path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="induced-", dir=spill_folder())
        self.files += 1
        return os.path.join(self.folder.name, str(self.files))

    def array(self, n: int, dtype) -> np.ndarray:
        if n <= self.memory_rows:
            return np.empty(n, dtype=dtype)
        return np.memmap(self.path(), dtype=dtype, mode="w+", shape=(n,))

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()
            self.folder = None

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class DiskQueue:
    """Priority queue of (key, position, common prefix), popped by whole keys, least key first.

    Entries of one key keep their order of arrival.  Beyond the memory budget the parts held
    are appended to one file, and read back when their key is popped.
    """

    def __init__(self, space: Workspace):
        self.space, self.keys, self.held = space, [], 0
        self.parts: dict[int, list] = {}
        self.file = None

    def push(self, key: int, at: np.ndarray, lcp: np.ndarray) -> None:
        if key not in self.parts:
            self.parts[key] = []
            heapq.heappush(self.keys, key)
        self.parts[key].append((at, lcp))
        self.held += len(at)
        if self.held > self.space.memory_rows:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = open(self.space.path(), "w+b")      # noqa: SIM115  lives as long as the queue
        for parts in self.parts.values():
            for i, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    begin = self.file.seek(0, os.SEEK_END)
                    self.file.write(part[0].astype(np.int64).tobytes())
                    self.file.write(part[1].astype(np.uint8).tobytes())
                    parts[i] = (begin, len(part[0]))
        self.held = 0

    def least(self) -> int | None:
        return self.keys[0] if self.keys else None

    def pop(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for a, b in self.parts.pop(heapq.heappop(self.keys)):
            if isinstance(a, np.ndarray):
                self.held -= len(a)
                out.append((a, b))
            else:
                self.file.seek(a)
                raw = self.file.read(9 * b)
                out.append((np.frombuffer(raw[:8 * b], np.int64), np.frombuffer(raw[8 * b:], np.uint8)))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _range_least(lcp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of lcp[lo..hi] (inclusive) for many ranges, by a table of powers of two."""
    table = [lcp]
    while 2 << (len(table) - 1) <= len(lcp):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), dtype=lcp.dtype)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][lo[at]], table[k][hi[at] - (1 << k) + 1])
    return out


class _Common:
    """Common prefixes of entries that a scan induces: one more than the least common prefix met
    since the last entry of the same bucket, at most ``cap``; 0 for a bucket's first entry."""

    def __init__(self, alphabet: int, cap: int):
        self.cap = cap
        self.since = np.full(alphabet, _FAR, dtype=np.uint8)
        self.met = np.zeros(alphabet, dtype=bool)

    def take(self, lcp: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """``at``: index in the scan of each entry, ascending within a key; ``key``: sorted."""
        first = np.append(True, key[1:] != key[:-1])
        out = np.empty(len(at), dtype=np.uint8)
        later = np.flatnonzero(~first)
        if len(later):
            out[later] = _range_least(lcp, at[later - 1] + 1, at[later])
        begin = np.flatnonzero(first)
        bucket = key[begin]
        out[begin] = np.minimum(self.since[bucket], np.minimum.accumulate(lcp)[at[begin]])
        out = np.minimum(out, self.cap - 1) + np.uint8(1)
        out[begin[~self.met[bucket]]] = 0
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(_FAR))
        np.minimum(self.since, lcp.min(), out=self.since)
        self.since[bucket] = after[at[np.append(begin[1:], len(at)) - 1] + 1]
        self.met[bucket] = True
        return out

    def skip(self, lcp: np.ndarray) -> None:
        """A scan that induces nothing."""
        np.minimum(self.since, lcp.min(), out=self.since)


_SCAN = 1 << 17


class _Level:
    """One string: its suffix types, and the induction of all suffixes from its S* ones."""

    def __init__(self, s: np.ndarray, space: Workspace, cap: int = 0):
        """``s`` ends with its only least symbol.  ``cap`` > 0: common prefixes up to it are wanted."""
        self.s, self.space, self.cap, n = s, space, cap, len(s)
        self.n = n
        change = np.flatnonzero(s[:-1] != s[1:])            # last places of runs (but the sentinel)
        size = np.diff(np.append(-1, change))
        ends = np.repeat(change, size)                      # place i -> last place of its run
        self.is_s = space.array(n, bool)
        self.is_s[:-1] = s[ends] < s[ends + 1]
        self.is_s[-1] = True
        if cap:
            self.run = space.array(n, np.uint8)
            self.run[:-1] = np.minimum(ends - np.arange(n - 1) + 1, cap)
            self.run[-1] = 1
        self.star = np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1

    def _scan(self, queue: DiskQueue, common: _Common | None, at: np.ndarray, lcp: np.ndarray, want_s: bool) -> None:
        for lo in range(0, len(at), _SCAN):
            part, near = at[lo:lo + _SCAN], lcp[lo:lo + _SCAN]
            before = part - 1
            index = np.flatnonzero((part > 0) & (self.is_s[before] == want_s))
            if not len(index):
                if common:
                    common.skip(near)
                continue
            key = self.s[before[index]].astype(np.int64)
            order = np.argsort(key, kind="stable")
            index, key = index[order], key[order]
            new = common.take(near, index, key) if common else np.zeros(len(index), dtype=np.uint8)
            place = before[index]
            cuts = np.append(np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1), len(key))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                queue.push(-int(key[a]) if want_s else int(key[a]), place[a:b], new[a:b])

    def _edge(self, last: int | None, first: int) -> int:
        """Common prefix of an L and an S suffix that meet in one bucket."""
        return 0 if last is None or not self.cap else min(int(self.run[last]), int(self.run[first]))

    def _buckets(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.s[at]
        cuts = np.append(np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)) if len(key) else np.zeros(1, int)
        return key[cuts[:-1]].astype(np.int64), cuts

    def induce(self, star: np.ndarray, star_lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order, with the common prefix of each and the one before it."""
        alphabet = int(self.s.max()) + 1 if self.cap else 0
        # Ascending: L suffixes from L and S* ones.
        l_at, l_lcp, filled = self.space.array(self.n, np.int64), self.space.array(self.n, np.uint8), 0
        queue, common = DiskQueue(self.space), _Common(alphabet, self.cap) if self.cap else None
        keys, cuts = self._buckets(star)
        begins: dict[int, tuple[int, int]] = {}
        k = 0
        while queue.least() is not None or k < len(keys):
            c = min(x for x in (queue.least(), int(keys[k]) if k < len(keys) else None) if x is not None)
            begin, last = filled, None
            while queue.least() == c:
                at, lcp = queue.pop()
                l_at[filled:filled + len(at)], l_lcp[filled:filled + len(at)] = at, lcp
                filled, last = filled + len(at), int(at[-1])
                self._scan(queue, common, at, lcp, False)
            begins[c] = (begin, filled)
            if k < len(keys) and keys[k] == c:
                at, lcp = star[cuts[k]:cuts[k + 1]], star_lcp[cuts[k]:cuts[k + 1]].copy()
                lcp[0] = self._edge(last, int(at[0]))
                self._scan(queue, common, at, lcp, False)
                k += 1
        queue.close()
        # Descending: S suffixes from S and L ones.
        out, out_lcp = self.space.array(self.n, np.int64), self.space.array(self.n, np.uint8)
        end = self.n
        queue, common = DiskQueue(self.space), _Common(alphabet, self.cap) if self.cap else None
        chars = sorted((c for c, (a, b) in begins.items() if b > a), reverse=True)
        k = 0
        while queue.least() is not None or k < len(chars):
            c = max(x for x in (-queue.least() if queue.least() is not None else None,
                                chars[k] if k < len(chars) else None) if x is not None)
            last, top = None, end
            while queue.least() == -c:
                at, lcp = queue.pop()
                # In place n-1-i the common prefix with the next larger one is put; shifted below.
                out[end - len(at):end], out_lcp[end - len(at):end] = at[::-1], lcp[::-1]
                end, last = end - len(at), int(at[-1])
                self._scan(queue, common, at, lcp, True)
            bottom, edge = end, 0
            if k < len(chars) and chars[k] == c:
                a, b = begins[c]
                at, lcp = l_at[a:b], l_lcp[a:b]
                edge = self._edge(last, int(at[-1]))
                self._scan(queue, common, at[::-1], np.append(np.uint8(edge), lcp[::-1][:-1]), True)
                out[end - len(at):end], out_lcp[end - len(at):end] = at, lcp
                end -= len(at)
                k += 1
            if top > bottom:        # S part: from "with the next one" to "with the one before"
                out_lcp[bottom + 1:top] = out_lcp[bottom:top - 1].copy()
                out_lcp[bottom] = edge
        queue.close()
        out[0], out_lcp[0] = self.n - 1, 0      # the sentinel
        if end != 1:
            raise AssertionError("induction left suffixes out")
        return out, out_lcp


def _refine(rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split the rank groups of the ``live`` members by ``key``; a group's rank is the number of smaller
    ones.  Returns the members whose group still has others."""
    order = np.lexsort((key, rank[live]))
    member, r, x = live[order], rank[live][order], key[order]
    group = np.append(True, r[1:] != r[:-1])
    sub = group | np.append(True, x[1:] != x[:-1])
    index = np.arange(len(member))
    group_begin = np.maximum.accumulate(np.where(group, index, 0))
    sub_begin = np.maximum.accumulate(np.where(sub, index, 0))
    rank[member] = r + sub_begin - group_begin
    alone = sub & np.append(sub[1:], True)
    return member[~alone]


def _name(level: _Level, words: np.ndarray | None) -> np.ndarray:
    """Rank of every S* suffix's substring (up to and including the next S*), in text order.

    Of two substrings one of which begins the other the shorter is larger: beyond its end comes the
    largest symbol.
    """
    star = level.star
    length = np.append(star[1:], level.n - 1) - star + 1
    rank = np.zeros(len(star), dtype=np.int64)
    live, k = np.arange(len(star)), 0
    width = _PACKED if words is not None else 1
    while len(live):
        left = length[live] - k
        at = np.minimum(star[live] + k, level.n - 1)
        if words is not None:
            pad = (width - np.clip(left, 0, width)).astype(np.uint64) * np.uint64(_BITS)
            key = words[at] | ((np.uint64(1) << pad) - np.uint64(1))
        else:
            key = np.where(left > 0, level.s[at], np.iinfo(np.int64).max)
        live = _refine(rank, live, key)
        k += width
        if len(live):       # equal substrings that have both ended are one name
            group_left = np.zeros(len(star), dtype=np.int64)
            np.maximum.at(group_left, rank[live], length[live])
            live = live[group_left[rank[live]] > k]
    return rank


def _order_in_memory(rank: np.ndarray, enough: int) -> np.ndarray:
    """Order of the suffixes of a string of ranks, exact for the first ``enough`` symbols, by doubling."""
    rank = rank.copy()
    counts = np.bincount(rank, minlength=len(rank))
    live, h = np.flatnonzero(counts[rank] > 1), 1
    while len(live) and h < enough:
        key = np.where(live + h < len(rank), rank[np.minimum(live + h, len(rank) - 1)], -1)
        live = _refine(rank, live, key)
        h *= 2
    return np.argsort(rank, kind="stable")


def _sort_stars(level: _Level, words: np.ndarray | None, enough: int) -> np.ndarray:
    """The S* suffixes in order."""
    star, space = level.star, level.space
    if len(star) <= 1:
        return star
    rank = _name(level, words)
    if len(rank) <= space.reduced_rows:
        return star[_order_in_memory(rank, enough)]
    # The names of the reduced string; its last one, the sentinel's substring, is the only least.
    below = _Level(rank, space)
    order, _ = below.induce(_sort_stars(below, None, len(rank)), np.zeros(len(below.star), dtype=np.uint8))
    return star[order]


_BITS, _PACKED = 9, 7       # symbols of 9 bits, 7 to a word


def _pack(s: np.ndarray, space: Workspace) -> np.ndarray:
    words = space.array(len(s), np.uint64)
    words[:] = 0
    for k in range(_PACKED):
        words <<= np.uint64(_BITS)
        words[:max(0, len(s) - k)] |= s[k:].astype(np.uint64)
    return words


def _star_common(order: np.ndarray, words: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each S* suffix with the one before it in order, at most ``cap``."""
    lcp = np.zeros(len(order), dtype=np.int64)
    live = np.arange(1, len(order))
    k = 0
    while len(live) and k < cap:
        at = np.minimum(order[live] + k, len(words) - 1)
        to = np.minimum(order[live - 1] + k, len(words) - 1)
        differ = words[at] ^ words[to]
        same = differ == 0
        got = np.zeros(len(live), dtype=np.int64)
        for j in range(1, _PACKED + 1):
            got += differ < (np.uint64(1) << np.uint64(_BITS * (_PACKED - j)))
        lcp[live] += got
        live = live[same]
        k += _PACKED
    return np.minimum(lcp, cap).astype(np.uint8)


def suffix_array(strings: list[bytes], cap: int, space: Workspace) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all strings in order (to their first ``cap`` symbols), the common prefix of each and the
    one before it (at most ``cap``, below 255), and the first place of every string.

    The strings are joined, each ended by a symbol below all bytes; an empty list has one suffix, the end.
    """
    if not 0 < cap < _FAR:
        raise ValueError(f"common prefixes are kept up to {_FAR - 1}")
    sizes = np.array([len(x) + 1 for x in strings], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    n = int(sizes.sum()) + 1
    s = space.array(n, np.uint16)
    at = 0
    for x in strings:
        s[at:at + len(x)] = np.frombuffer(x, dtype=np.uint8)
        s[at:at + len(x)] += 2
        s[at + len(x)] = 1
        at += len(x) + 1
    s[n - 1] = 0
    level = _Level(s, space, cap)
    words = _pack(s, space)
    star = _sort_stars(level, words, cap)
    order, lcp = level.induce(star, _star_common(star, words, cap))
    return order, lcp, begin
