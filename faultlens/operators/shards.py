"""Boosting rounds over the rows that one task holds.

Rows are worked on in blocks that fit a core's cache, and a row remembers the node it has reached: a level costs one pass
over the rows, and no tree is walked for the rows it was grown from.  Of two children only the one with fewer rows is summed; the
other one's sums are what is left of the parent's.  Statistics are whole numbers, so this is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from faultlens.operators import growth as G
from faultlens.operators.binning import JUDGED, TRAIN

# Rows that are worked on at once, and most cells of a bundle (features of few codes that are summed as one).
BLOCK_ROWS = 1 << 14
BUNDLE_CELLS = 1 << 11


class Shard:
    """Rows of a training table by part: those that trees are grown from and those that judge the rounds."""

    def __init__(self, codes: np.ndarray, y: np.ndarray, part: np.ndarray):
        pick = [part == p for p in (TRAIN, JUDGED)]
        self.codes = [np.ascontiguousarray(codes[:, p]) for p in pick]
        self.labels = [y[p].astype(np.uint8) for p in pick]
        own = self.codes[TRAIN]
        self.radix = [int(c.max(initial=0)) + 1 for c in own]
        self.bundles = bundles(self.radix)
        self.bundled = []
        for features in self.bundles:
            cell = own[features[0]].astype(np.uint16)
            for f in features[1:]:
                cell = cell * np.uint16(self.radix[f]) + own[f]
            self.bundled.append(cell)


def bundles(radix: list[int], most: int = BUNDLE_CELLS) -> list[list[int]]:
    """Features, with so many codes each, in groups of at most ``most`` combinations."""
    out: list[list[int]] = []
    cells: list[int] = []
    for f in sorted(range(len(radix)), key=lambda f: -radix[f]):
        fits = [i for i, n in enumerate(cells) if n * radix[f] <= most]
        if fits:
            best = max(fits, key=lambda i: cells[i])
            out[best].append(f)
            cells[best] *= radix[f]
        else:
            out.append([f])
            cells.append(radix[f])
    return out


def blocks(n: int, least: int = 0) -> Iterator[slice]:
    step = max(BLOCK_ROWS, least)
    return (slice(at, min(at + step, n)) for at in range(0, n, step))


class Grower:
    """A model's rounds over the rows of a shard."""

    def __init__(self, shard: Shard, rule: G.Boosted, max_depth: int, width: int):
        self.shard, self.rule, self.max_depth, self.width = shard, rule, max_depth, width
        self.margins = [np.zeros(len(y)) for y in shard.labels]

    def grow(self) -> G.Tree:
        """One more tree; its values are added to the margins."""
        n = len(self.shard.labels[TRAIN])
        self.a, self.b, self.slot = np.empty(n), np.empty(n), np.zeros(n, np.int64)
        for some in blocks(n):
            self.a[some], self.b[some] = G.gradients(self.margins[TRAIN][some], self.shard.labels[TRAIN][some])
        front = G.Frontier(self.rule, float(self.a.sum()), float(self.b.sum()))
        if self.max_depth < 1 or not self.rule.open(front.a, front.b)[0]:
            front.close()
            self.slot[:] = -1
        else:
            self._levels(front)
        tree = front.tree()
        value = self.rule.value(*(np.concatenate([d[i] for d in front.done]) for i in (5, 6)))
        for some in blocks(n):
            self.margins[TRAIN][some] += value.take(-1 - self.slot[some])
        self._follow(tree, JUDGED)
        return tree

    def follow(self, tree: G.Tree) -> None:
        """Add an earlier round's values to the margins."""
        for part in (TRAIN, JUDGED):
            self._follow(tree, part)

    def _follow(self, tree: G.Tree, part: int) -> None:
        codes, margin = self.shard.codes[part], self.margins[part]
        for some in blocks(len(margin)):
            margin[some] += tree.value.take(tree.leaves(codes[:, some]))

    def _levels(self, front: G.Frontier) -> None:
        """Split the open nodes depth by depth.  ``slot`` of a row is its open node's position, or -1 less the place of its
        leaf among the settled nodes."""
        hist = self._sums(np.zeros(1, np.int64), 1)
        while True:
            s = G.best_splits(hist, self.rule)
            use, settled = s.gain > 0, sum(len(d[0]) for d in front.done)
            front.split(s)
            after = settled + len(use)
            ends = np.ones(len(front.node), bool) if front.depth >= self.max_depth else ~self.rule.open(front.a, front.b)
            child = np.where(ends, -1 - (after + np.cumsum(ends) - 1), np.cumsum(~ends) - 1)
            to = np.repeat(-1 - (settled + np.arange(len(use))), 2)
            to[np.repeat(use, 2)] = child
            # Of siblings, the one with the smaller Hessian is summed.
            light = np.argmin(front.b.reshape(-1, 2), axis=1)
            front.close(ends)
            self._route(s, to)
            if not len(front.node):
                return
            hist = self._children(hist[use], ends.reshape(-1, 2), light)

    def _children(self, parents: np.ndarray, ends: np.ndarray, light: np.ndarray) -> np.ndarray:
        """Sums of the open children, by pairs: the lighter child's own, what the parent has beside it for the other one."""
        pairs = np.flatnonzero(~ends.all(axis=1))
        both = ~ends[pairs].any(axis=1)
        at = np.cumsum(~ends.reshape(-1)).reshape(-1, 2) - 1            # slots of the open children
        summed = np.where(both, light[pairs], ends[pairs, 0].astype(int))   # an only child is summed itself
        own = at[pairs, summed]
        among = np.full(int((~ends).sum()), -1)
        among[own] = np.arange(len(pairs))
        sums = self._sums(among, len(pairs))
        out = np.empty((len(among), *sums.shape[1:]))
        out[own] = sums
        out[at[pairs[both], 1 - summed[both]]] = parents[pairs[both]] - sums[both]
        return out

    def _sums(self, among: np.ndarray, nodes: int) -> np.ndarray:
        """[node, feature, code, statistic] sums over the rows of the open nodes chosen by ``among`` (their position, -1: none)."""
        shard, width = self.shard, self.width
        cells = [int(np.prod([shard.radix[f] for f in g])) for g in shard.bundles]
        found = [np.zeros((2, nodes * n)) for n in cells]
        among = np.append(among, -1)                    # slots below 0 are settled
        for some in blocks(len(self.slot), 4 * nodes * max(cells, default=1)):
            slot, a, b = among.take(np.maximum(self.slot[some], -1)), self.a[some], self.b[some]
            live = np.flatnonzero(slot >= 0)
            whole = len(live) == len(slot)
            if not whole:
                slot, a, b = slot.take(live), a.take(live), b.take(live)
            for code, n, sums in zip(shard.bundled, cells, found):
                key = slot * n + (code[some] if whole else code[some].take(live))
                sums[0] += np.bincount(key, a, minlength=nodes * n)
                sums[1] += np.bincount(key, b, minlength=nodes * n)
        out = np.zeros((nodes, len(shard.radix), width, 2))
        for features, sums in zip(shard.bundles, found):
            cube = sums.reshape(2, nodes, *[shard.radix[f] for f in features])
            for i, f in enumerate(features):
                rest = tuple(2 + j for j in range(len(features)) if j != i)
                out[:, f, :shard.radix[f]] = cube.sum(axis=rest).transpose(1, 2, 0)
        return out

    def _route(self, s: G.Splits, to: np.ndarray) -> None:
        codes = self.shard.codes[TRAIN]
        n = codes.shape[1]
        flat, first = codes.reshape(-1), s.feature.astype(np.int64) * n
        code = np.arange(self.width)
        left = np.where(code == 0, s.missing_left[:, None], code <= s.code[:, None])
        target = np.where(left, to[::2, None], to[1::2, None]).reshape(-1)      # by slot and code
        for some in blocks(n):
            slot, rows = self.slot[some], np.arange(some.start, some.stop)
            live = np.flatnonzero(slot >= 0)
            whole = len(live) == len(slot)
            at = slot if whole else slot.take(live)
            c = flat.take(first.take(at) + (rows if whole else rows.take(live)))
            new = target.take(at * self.width + c)
            if whole:
                self.slot[some] = new
            else:
                slot[live] = new
