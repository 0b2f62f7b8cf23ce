"""Growing one level of trees from histograms: the arithmetic that every fit shares.

A row carries two statistics, whose sums decide splits and leaf values: for boosting gradient and
Hessian of the logistic loss, for forests the weight of class 1 and the whole weight.  They are
whole numbers (boosting rounds to 2^-22), so sums are exact in any order and a tree does not depend on how its rows are
spread over tasks.  Missing values are a bin of their own and go to the side where they help more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

SCALE = float(1 << 22)          # gradients and Hessians are sums of multiples of 1 / SCALE
# Defaults of the boosted model (L2 penalty of leaf weights, least Hessian of a child).
L2, MIN_CHILD_WEIGHT = 1.0, 1.0
LEAST_GAIN = 1e-6
PAIRED = float(1 << 26)         # counts below this share a number with another one
SLOTS = 64                      # nodes whose splits are searched in one piece
BLOCK_ROWS = 1 << 14            # rows that are worked on at once, within a core's cache


@dataclass(frozen=True)
class Boosted:
    """Second-order objective: gain and leaf weight from gradient sum a and Hessian sum b."""
    step: float = 0.3
    l2: float = L2
    min_child: float = MIN_CHILD_WEIGHT
    counts = False                  # statistics are small whole numbers, none negative

    def score(self, a, b):
        return (a / SCALE) ** 2 / (b / SCALE + self.l2)

    def allowed(self, b):
        return b >= self.min_child * SCALE

    def open(self, a, b):
        return b >= 2 * self.min_child * SCALE

    def value(self, a, b):
        return -self.step * (a / SCALE) / (b / SCALE + self.l2)

    def cover(self, b):
        return b / SCALE


@dataclass(frozen=True)
class Gini:
    """Gini impurity from the class-1 weight a and the whole weight b; a leaf's value is its share of class 1."""
    counts = True

    def score(self, a, b):
        return (a * a + (b - a) * (b - a)) / np.maximum(b, 1)

    def allowed(self, b):
        return b >= 1

    def open(self, a, b):
        return (a > 0) & (a < b)

    def value(self, a, b):
        return a / np.maximum(b, 1)

    def cover(self, b):
        return b * 1.0


@dataclass
class Tree:
    """Nodes in ascending order of their path number (root 1, children 2i and 2i + 1); leaves have feature -1."""
    node: np.ndarray
    feature: np.ndarray
    code: np.ndarray
    missing_left: np.ndarray
    gain: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    left: np.ndarray = field(init=False)        # position of the left child, the right one follows; -1 at leaves

    def __post_init__(self):
        at = np.searchsorted(self.node, 2 * self.node)
        self.left = np.where(self.feature >= 0, at, -1)

    def leaves(self, codes: np.ndarray, most: int | None = None) -> np.ndarray:
        """Position of the node where each column of ``codes`` [feature, row] ends, after ``most`` steps at most."""
        return next(self.walk(codes, [most]))

    def walk(self, codes: np.ndarray, steps: list[int | None]) -> Iterator[np.ndarray]:
        """What :meth:`leaves` gives for each of the ascending ``steps`` (None: to the end), in one walk.
        The array is the same one each time."""
        n = codes.shape[1]
        flat, ends = np.ascontiguousarray(codes).reshape(-1), self.left < 0
        first = np.where(ends, 0, self.feature) * n             # where a node's feature begins in ``flat``
        # Code 0 goes left as the least value, or wraps to the greatest one and goes right.
        off = (~self.missing_left).astype(np.uint8)
        least = np.where(ends, 0, self.code - off).astype(np.uint8)
        out = np.zeros(n, np.int64)
        rows, at, done = np.arange(n), np.zeros(n, np.int64), 0
        for most in steps:
            while len(rows) and (most is None or done < most):
                end = ends.take(at)
                left = np.count_nonzero(end)
                if left:                                        # rows that have ended leave
                    out[rows[end]] = at[end]
                    rows, at = rows[~end], at[~end]
                c = flat.take(first.take(at) + rows)
                at = self.left.take(at) + (c - off.take(at) > least.take(at))
                done += 1
            out[rows] = at
            yield out

    def columns(self) -> dict[str, np.ndarray]:
        return {c: getattr(self, c) for c in ARRAYS}


ARRAYS = {"node": "long", "feature": "int", "code": "int", "missing_left": "boolean", "gain": "double", "value": "double",
          "cover": "double"}
_TYPES = {"node": np.int64, "feature": np.int32, "code": np.int32, "missing_left": bool, "gain": float, "value": float, "cover": float}


def tree_of(row) -> Tree:
    """A tree from a row (mapping) of the trees table."""
    return Tree(**{c: np.asarray(row[c], dtype=t) for c, t in _TYPES.items()})


def histogram(codes: np.ndarray, slot: np.ndarray, a: np.ndarray, b: np.ndarray, slots: int, width: int,
              features: np.ndarray | None = None) -> np.ndarray:
    """[slot, feature, code, statistic] sums over the columns of ``codes`` [feature, row].

    ``features`` [slot, k] restricts each slot to its own k features.
    """
    k = codes.shape[0] if features is None else features.shape[1]
    out = np.empty((slots, k, width, 2))
    n = codes.shape[1]
    flat, rows, first = codes.reshape(-1), np.arange(n), slot * width
    for j in range(k):
        key = first + (codes[j] if features is None else flat.take(features[:, j].take(slot) * n + rows))
        for s, w in enumerate((a, b)):
            out[:, j, :, s] = np.bincount(key, w, minlength=slots * width).reshape(slots, width)
    return out


def count_histogram(codes: np.ndarray, slot: np.ndarray, a: np.ndarray, b: np.ndarray, slots: int, width: int,
                    features: np.ndarray) -> np.ndarray:
    """:func:`histogram` of statistics that are counts (:class:`Gini`), as whole numbers; both are added up at once."""
    if b.sum() >= PAIRED:
        return histogram(codes, slot, a, b, slots, width, features).astype(np.int64)
    n, k = codes.shape[1], features.shape[1]
    flat, rows, first, both = codes.reshape(-1), np.arange(n), slot * width, a * PAIRED + b
    out = np.empty((slots, k, width, 2), np.int64)
    for j in range(k):
        c = flat.take(features[:, j].take(slot) * n + rows)
        sums = np.bincount(first + c, both, minlength=slots * width).astype(np.int64).reshape(slots, width)
        out[:, j, :, 0], out[:, j, :, 1] = sums >> 26, sums & (int(PAIRED) - 1)
    return out


@dataclass
class Splits:
    """Best split per slot (gain 0: none); ``a_left`` and ``b_left`` are the left child's sums."""
    gain: np.ndarray
    feature: np.ndarray
    code: np.ndarray
    missing_left: np.ndarray
    a_left: np.ndarray
    b_left: np.ndarray


def best_splits(hist: np.ndarray, rule, features: np.ndarray | None = None) -> Splits:
    """Best split of every slot; ties go to the first feature, then the lowest code, then missing to the right."""
    parts = [_best(hist[i:i + SLOTS], rule, None if features is None else features[i:i + SLOTS]) for i in range(0, len(hist), SLOTS)]
    return Splits(*(np.concatenate([p[i] for p in parts]) for i in range(6)))


def _best(hist, rule, features):
    slots, k, width, _ = hist.shape
    total = hist.sum(axis=2)[:, :1]                                  # [slot, 1, 2]
    below = np.cumsum(hist[:, :, 1:], axis=2)                        # sums of the values at or below each code
    left = np.stack([below, below + hist[:, :, :1]], axis=3)         # missing right, missing left
    right = total[:, :, None, None] - left
    whole = rule.score(total[..., 0], total[..., 1])[:, :, None, None]
    gain = rule.score(left[..., 0], left[..., 1]) + rule.score(right[..., 0], right[..., 1]) - whole
    fine = rule.allowed(left[..., 1]) & rule.allowed(right[..., 1])
    gain = np.where(fine, gain, -1.0).reshape(slots, -1)
    best = gain.argmax(axis=1)
    at = np.arange(slots)
    j, rest = best // ((width - 1) * 2), best % ((width - 1) * 2)
    chosen = left[at, j, rest // 2, rest % 2]
    use = gain[at, best] > LEAST_GAIN
    feature = j if features is None else features[at, j]
    return (np.where(use, gain[at, best], 0.0), feature.astype(np.int32), (rest // 2 + 1).astype(np.int32), rest % 2 == 1,
            chosen[:, 0], chosen[:, 1])


def row_splits(codes: np.ndarray, slot: np.ndarray, a: np.ndarray, b: np.ndarray, slots: int, width: int, rule,
               features: np.ndarray | None = None) -> Splits:
    """What :func:`best_splits` finds on the :func:`histogram` of rows that all count (b > 0), each slot having some.

    Only codes that occur are judged: the work follows the rows, also where a level has many small nodes.
    A code that does not occur parts the rows as the next lower one does, and of equal splits the lower code counts.
    """
    n = codes.shape[1]
    k = codes.shape[0] if features is None else features.shape[1]
    flat, rows = codes.reshape(-1), np.arange(n)
    first = slot * width
    paired = rule.counts and b.sum() < PAIRED       # both statistics as one whole number below 2^53
    weights = [a * PAIRED + b] if paired else [a, b]
    found = [np.empty((slots, k, width)) for _ in weights]
    for j in range(k):
        c = codes[j] if features is None else flat.take(features[:, j].take(slot) * n + rows)
        key = first + c
        for out, w in zip(found, weights):
            out[:, j] = np.bincount(key, w, minlength=slots * width).reshape(slots, width)
    return _cell_splits([out.reshape(-1) for out in found], k, width, rule, features)


def _cell_splits(found: list[np.ndarray], k: int, width: int, rule, features: np.ndarray | None) -> Splits:
    """Best splits from the flat [slot, feature, code] sums of both statistics, or of both as one number (:data:`PAIRED`)."""
    paired = len(found) == 1
    cell = np.flatnonzero(found[-1])
    ca, cb = found[0][cell], found[-1][cell]
    if paired:
        ca = np.floor(cb / PAIRED)
        cb = cb - ca * PAIRED
    group = cell // width
    code = cell - group * width
    new = np.append(True, group[1:] != group[:-1])
    start = np.flatnonzero(new)                     # every slot has cells of each of its features
    size = np.diff(np.append(start, len(cell)))

    def sums(x):
        """(codes at or below, missing ones, all) of each cell's slot and feature."""
        up = np.cumsum(x)
        before = up[start] - x[start]
        return up - np.repeat(before, size), np.repeat(np.where(code[start] == 0, x[start], 0.0), size), \
            np.repeat(up[start + size - 1] - before, size)

    (la, ma, ta), (lb, mb, tb) = sums(ca), sums(cb)
    whole = rule.score(ta, tb)

    def gain(a_left, b_left):
        g = rule.score(a_left, b_left) + rule.score(ta - a_left, tb - b_left) - whole
        return np.where(rule.allowed(b_left) & rule.allowed(tb - b_left), g, -1.0)

    missing = code == 0                             # alone on the left: as code 1, unless that occurs
    taken = missing & np.append(~new[1:] & (code[1:] == 1), False)
    gains = np.stack([np.where(missing, -1.0, gain(la - ma, lb - mb)), np.where(taken, -1.0, gain(la, lb))], axis=1).reshape(-1)
    of = group // k
    slot_start = start[::k]
    best = np.maximum.reduceat(gains, 2 * slot_start)
    at = np.flatnonzero(gains == best.take(np.repeat(of, 2)))
    at = at[np.append(True, of[at[1:] // 2] != of[at[:-1] // 2])]
    i, left = at // 2, at % 2 == 1
    j = group[i] % k
    return Splits(np.where(best > LEAST_GAIN, best, 0.0), (j if features is None else features[np.arange(len(j)), j]).astype(np.int32),
                  np.maximum(code[i], 1).astype(np.int32), left, np.where(left, la[i], la[i] - ma[i]), np.where(left, lb[i], lb[i] - mb[i]))


class Frontier:
    """A tree under construction: its settled nodes and the open ones of the current depth."""

    def __init__(self, rule, a: float, b: float, root: int = 1, depth: int = 0):
        self.rule, self.depth = rule, depth
        self.done: list[tuple] = []             # (node, feature, code, missing_left, gain, a, b) arrays
        self.node = np.array([root], np.int64)
        self.a, self.b = np.array([a], float), np.array([b], float)

    def close(self, which: np.ndarray | None = None) -> None:
        """Make the chosen open nodes (default all) leaves."""
        which = np.ones(len(self.node), bool) if which is None else which
        n = int(which.sum())
        self.done.append((self.node[which], np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n),
                          self.a[which], self.b[which]))
        self.node, self.a, self.b = self.node[~which], self.a[~which], self.b[~which]

    def split(self, s: Splits) -> None:
        """Settle all open nodes by their splits; their children are the open nodes of the next depth."""
        use = s.gain > 0
        self.done.append((self.node, np.where(use, s.feature, -1).astype(np.int32), np.where(use, s.code, 0).astype(np.int32),
                          use & s.missing_left, s.gain, self.a, self.b))
        pair = lambda left, whole: np.stack([left, whole - left], axis=1).reshape(-1)      # noqa: E731
        node = self.node[use]
        self.a, self.b = pair(s.a_left[use], self.a[use]), pair(s.b_left[use], self.b[use])
        self.node = np.stack([2 * node, 2 * node + 1], axis=1).reshape(-1)
        self.depth += 1

    def tree(self) -> Tree:
        cols = [np.concatenate(x) for x in zip(*self.done)]
        order = np.argsort(cols[0], kind="stable")
        node, feature, code, missing_left, gain, a, b = (c[order] for c in cols)
        return Tree(node, feature, code, missing_left, gain, self.rule.value(a, b), self.rule.cover(b))


def grow(codes: np.ndarray, a: np.ndarray, b: np.ndarray, max_depth: int, width: int, rule,
         choose: Callable[[np.ndarray], np.ndarray] | None = None, root: int = 1, depth: int = 0) -> Tree:
    """A (sub)tree from all its rows in memory; ``choose(nodes)`` gives the features each node may use."""
    if choose and rule.counts and b.sum() < PAIRED:
        return _grow_counts(codes, a, b, max_depth, width, rule, choose, root, depth)
    tree = Frontier(rule, float(a.sum()), float(b.sum()), root, depth)
    slot = np.zeros(codes.shape[1], np.int64)
    while len(tree.node):
        if tree.depth >= max_depth:
            tree.close()
            break
        ends = ~rule.open(tree.a, tree.b)
        if ends.any():                      # their rows leave
            stay = ~ends[slot]
            slot = (np.cumsum(~ends) - 1)[slot[stay]]
            codes, a, b = codes[:, stay], a[stay], b[stay]
            tree.close(ends)
            if not len(tree.node):
                break
        features = choose(tree.node) if choose else None
        s = row_splits(codes, slot, a, b, len(tree.node), width, rule, features)
        use = s.gain > 0
        at = slot
        if not use.all():                   # rows of nodes without a split leave
            stay = use[slot]
            at = slot[stay]
            codes, a, b = codes[:, stay], a[stay], b[stay]
        c = codes.reshape(-1).take(s.feature.astype(np.int64).take(at) * len(at) + np.arange(len(at)))
        left = np.where(c == 0, s.missing_left[at], c <= s.code[at])
        slot = 2 * (np.cumsum(use) - 1)[at] + ~left
        tree.split(s)
    return tree.tree()


def _grow_counts(codes: np.ndarray, a: np.ndarray, b: np.ndarray, max_depth: int, width: int, rule,
                 choose: Callable[[np.ndarray], np.ndarray], root: int, depth: int) -> Tree:
    """:func:`grow` for statistics that are counts.  Rows keep their place in ``codes`` and leave with their node; a level is
    two passes over the rows that are left, in blocks."""
    tree = Frontier(rule, float(a.sum()), float(b.sum()), root, depth)
    tree.close(np.array([True]) if depth >= max_depth else ~rule.open(tree.a, tree.b))
    n, flat = codes.shape[1], np.ascontiguousarray(codes).reshape(-1)
    rows = np.flatnonzero(b)
    both, slot = (a * PAIRED + b).take(rows), np.zeros(len(rows), np.int64)
    while len(tree.node):
        features = choose(tree.node).astype(np.int64)
        s = _cell_splits([_paired_sums(flat, n, rows, both, slot, features, width)], features.shape[1], width, rule, features)
        use = s.gain > 0
        tree.split(s)
        ends = np.ones(len(tree.node), bool) if tree.depth >= max_depth else ~rule.open(tree.a, tree.b)
        to = np.full(2 * len(use), -1)
        to[np.repeat(use, 2)] = np.where(ends, -1, np.cumsum(~ends) - 1)
        tree.close(ends)
        if len(tree.node):
            rows, both, slot = _routed(flat, n, rows, both, slot, s, to)
    return tree.tree()


def _paired_sums(flat: np.ndarray, n: int, rows: np.ndarray, both: np.ndarray, slot: np.ndarray, features: np.ndarray,
                 width: int) -> np.ndarray:
    """Flat [slot, feature, code] sums of ``both``."""
    slots, k = features.shape
    out = np.zeros((k, slots * width))
    first = features.T * n
    step = max(BLOCK_ROWS, 4 * slots * width)
    for at in range(0, len(rows), step):
        r, s, w = rows[at:at + step], slot[at:at + step], both[at:at + step]
        cell = s * width
        for j in range(k):
            place = first[j].take(s)
            place += r
            out[j] += np.bincount(cell + flat.take(place), w, minlength=slots * width)
    return np.ascontiguousarray(out.reshape(k, slots, width).transpose(1, 0, 2)).reshape(-1)


def _routed(flat: np.ndarray, n: int, rows: np.ndarray, both: np.ndarray, slot: np.ndarray, s: Splits,
            to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, their statistics, their slots) at the next depth; ``to`` has the slots of each node's two children, -1 where it ends."""
    first = s.feature.astype(np.int64) * n
    # As in Tree.walk: code 0 goes left as the least value, or wraps to the greatest one and goes right.
    off = (~s.missing_left).astype(np.uint8)
    least = (s.code - off).astype(np.uint8)
    out = []
    for at in range(0, len(rows), BLOCK_ROWS):
        r, old = rows[at:at + BLOCK_ROWS], slot[at:at + BLOCK_ROWS]
        place = first.take(old)
        place += r
        new = to.take(2 * old + (flat.take(place) - off.take(old) > least.take(old)))
        stay = np.flatnonzero(new >= 0)
        out.append((r.take(stay), both[at:at + BLOCK_ROWS].take(stay), new.take(stay)))
    return tuple(np.concatenate(x) for x in zip(*out))


# ---------------------------------------------------------------------------------- statistics of rows

def gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss, as multiples of 1 / SCALE."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - y) * SCALE), np.maximum(np.rint(p * (1.0 - p) * SCALE), 1.0)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each 64-bit value."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(*parts: int) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = _mixed(out * np.uint64(3) + np.array([p % (1 << 64)], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out[0]


# Poisson(1) as its cumulated probabilities: how often a row is drawn into a bootstrap sample.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 15)]))


# The same bounds for 53 random bits, and the count for the highest 16 bits where these decide it (else 255).
_BOUNDS = np.ceil(_POISSON * float(1 << 53)).astype(np.uint64)
_LOWEST = np.arange(1 << 16, dtype=np.uint64) << np.uint64(37)
_DRAWN = np.searchsorted(_BOUNDS, _LOWEST, side="right")
_DRAWN = np.where(np.searchsorted(_BOUNDS, _LOWEST + np.uint64((1 << 37) - 1), side="right") == _DRAWN, _DRAWN, 255).astype(np.uint8)


def bootstrap(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Times each row (by the 64-bit hash of its key) is drawn for a tree; no other state is involved."""
    u = _mixed(keys.view(np.uint64) ^ _stream(seed, tree))
    out = _DRAWN.take((u >> np.uint64(48)).view(np.int64)).astype(float)
    open_ = np.flatnonzero(out == 255)
    out[open_] = np.searchsorted(_BOUNDS, u[open_] >> np.uint64(11), side="right")
    return out


def feature_subsets(nodes: np.ndarray, n_features: int, k: int, seed: int, tree: int) -> np.ndarray:
    """[node, k] features that each node of a tree may split on, ascending, drawn by (seed, tree, node)."""
    base = _stream(seed, tree, 1)
    draw = _mixed(_mixed(nodes.astype(np.uint64) ^ base)[:, None] + np.arange(n_features, dtype=np.uint64)[None, :])
    return np.sort(np.argsort(draw, axis=1, kind="stable")[:, :k], axis=1)


def exact_auc(score: np.ndarray, y: np.ndarray) -> float | None:
    """Rank-sum AUC with ties counted one half; None without both classes."""
    _, where = np.unique(score, return_inverse=True)
    pos = np.bincount(where, y, minlength=int(where.max(initial=-1)) + 1)
    neg = np.bincount(where, 1 - y, minlength=len(pos))
    above = pos.sum() - np.cumsum(pos)
    total = 2.0 * pos.sum() * neg.sum()
    return float((neg * (2 * above + pos)).sum() / total) if total else None
