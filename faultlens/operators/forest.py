"""Random forests whose trees can be cut: fewer trees and less depth are parts of the same forest.

What is random about a tree depends on (seed, tree) and the row or the node alone: how often a row is drawn
comes from a hash of its key, a node's features from a hash of its path number.  So a shallower tree
is the top of the deeper one, fewer trees are a prefix, and one growth serves every trial of a search.

Growth starts level by level: tasks add up histograms keyed by (tree, node) as in boosting.  Trees of
few levels are grown so to their end, as their histograms are far smaller than their rows.  Of deeper ones, a
node with at most ``task_rows`` rows is finished where its rows meet, as one group of a job.  A
training table of at most so many rows is sent once to each group of trees, which grows them whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.operators import growth as G
from faultlens.operators.binning import TRAIN, chunk_batches
from faultlens.operators.boosting import TREES, Member, unit_rows
from faultlens.session import ship_package, shuffles_dropped, unique_dir

# Histograms that a task holds for the trees whose levels are grown together over a large table.
PASS_BYTES = 1 << 25
# Most nodes of a depth for which trees are grown by levels to their end.
LEVEL_NODES = 64
# Nodes of a tree whose histograms meet in one group.
GROUP_NODES = 16
# Chunks whose rows are added to the histograms at once.
BLOCK_CHUNKS = 4
# Bytes of drawn rows that are dealt to unfinished nodes at a time: what the shuffle of a pass may hold on disk.
DEAL_BYTES = 1 << 30
# Of a tree's rows those that are drawn at least once, 1 - 1 / e.
DRAWN_SHARE = 0.64
# Whole trees that one task grows from a small table's rows, which it gets once.
TREES_PER_TASK = 16
RULE = G.Gini()


@dataclass(frozen=True)
class Plan:
    """One forest of a joint fit; tree t is grown to ``depths[t]``."""
    model: int
    unit: str
    seed: int
    subset: str
    depths: tuple[int, ...]


def plan_of(member: Member) -> Plan:
    s = member.spec
    return Plan(member.model, member.unit, s.seed, s.feature_subset, (s.max_depth,) * s.n_trees)


def features_per_node(subset: str, n_features: int) -> int:
    if subset == "sqrt":
        return max(1, int(math.sqrt(n_features)))
    if subset == "all":
        return n_features
    raise ValueError(f"feature_subset is 'sqrt' or 'all', not {subset!r}")


def _chooser(plan: Plan, tree: int, n_features: int):
    k = features_per_node(plan.subset, n_features)
    return lambda nodes: G.feature_subsets(nodes, n_features, k, plan.seed, tree)


def _weighted(plan: Plan, tree: int, keys: np.ndarray, y: np.ndarray):
    w = G.bootstrap(keys, plan.seed, tree)
    return y * w, w


def _train(labels: bytes, parts: bytes, keys: bytes, codes: bytes, n: int):
    """(codes, keys, labels) of a chunk's training rows."""
    train = np.frombuffer(parts, np.uint8) == TRAIN
    return (np.frombuffer(codes, np.uint8).reshape(-1, n)[:, train], np.frombuffer(keys, np.int64)[train],
            np.frombuffer(labels, np.uint8)[train].astype(float))


def fit_forests(chunks: DataFrame, plans: list[Plan], width: int, n_features: int, task_rows: int) -> DataFrame:
    """The trees table of all forests, written pass by pass; the shuffle files of a pass go with it."""
    spark = chunks.sparkSession
    ship_package(spark)
    rows = unit_rows(chunks)
    small = [p for p in plans if rows.get(p.unit, 0) <= task_rows]
    path = unique_dir(spark, "model/trees")
    with shuffles_dropped(spark):
        if small:
            _whole(chunks, small, width, n_features).write.mode("append").parquet(path)
        for p in plans:
            if p in small:
                continue
            step = _trees_per_pass(p, rows[p.unit], width, n_features, task_rows)
            for first in range(0, len(p.depths), step):
                with chunk_batches(spark):
                    tops = _tops(chunks, p, range(first, min(first + step, len(p.depths))), width, n_features, task_rows)
                    for some in _dealt_together(tops, n_features):
                        below = _finish(chunks, {(p.model, t): (p, f) for t, f in some.items() if len(f.node)}, width, n_features)
                        _assembled(chunks, p.model, some, below).write.mode("append").parquet(path)
    return spark.read.schema(TREES).parquet(path)


def _dealt_together(tops: dict[int, G.Frontier], n_features: int) -> Iterator[dict[int, G.Frontier]]:
    """The trees in passes whose open nodes' rows are about ``DEAL_BYTES`` at most."""
    out: dict[int, G.Frontier] = {}
    size = 0.0
    for t, f in tops.items():
        own = float(f.b.sum()) * DRAWN_SHARE * (n_features + 1)         # b counts a row as often as it is drawn: once on average
        if out and size + own > DEAL_BYTES:
            yield out
            out, size = {}, 0.0
        out[t] = f
        size += own
    if out:
        yield out


# ---------------------------------------------------------------------------------- small tables, whole trees

def _whole(chunks: DataFrame, plans: list[Plan], width: int, n_features: int) -> DataFrame:
    """Trees grown from all rows of their unit: a group of a job per ``TREES_PER_TASK`` trees."""
    spark = chunks.sparkSession
    batches = [(p.model, p.unit, first) for p in plans for first in range(0, len(p.depths), TREES_PER_TASK)]
    shared = spark.sparkContext.broadcast({p.model: p for p in plans})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        plan, first = shared.value[int(pdf["model"].iloc[0])], int(pdf["first"].iloc[0])
        parts = [_train(*x) for x in zip(*(pdf[c] for c in ("labels", "parts", "keys", "codes", "n")))]
        codes = np.concatenate([p[0] for p in parts], axis=1)
        keys, y = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        rows: list[dict] = []
        if not len(y):
            return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in TREES.split(", ")])
        for t in range(first, min(first + TREES_PER_TASK, len(plan.depths))):
            a, b = _weighted(plan, t, keys, y)
            drawn = b > 0
            tree = G.grow(codes[:, drawn], a[drawn], b[drawn], plan.depths[t], width, RULE, _chooser(plan, t, n_features))
            rows.append({"model": plan.model, "tree": t, **tree.columns(), "auc": None})
        return pd.DataFrame(rows)

    own = spark.createDataFrame(batches, "model int, unit string, first int")
    n = min(4 * len(batches), 4096)
    return chunks.join(own, "unit").repartition(n, "model", "first").groupBy("model", "first").applyInPandas(fit, TREES)


# ---------------------------------------------------------------------------------- top levels of large tables

def _by_levels(depth: int) -> bool:
    """Whether a tree of this depth is grown by levels to its end."""
    return 1 << max(depth - 1, 0) <= LEVEL_NODES


def _trees_per_pass(plan: Plan, rows: int, width: int, n_features: int, task_rows: int) -> int:
    """Trees whose histograms, at their widest level, a task holds in ``PASS_BYTES``."""
    deepest = max(plan.depths)
    # Open nodes have more than task_rows of the drawn rows each, or are the nodes of few levels.
    nodes = LEVEL_NODES + rows // max(task_rows, 1) if not _by_levels(deepest) else 1 << max(deepest - 1, 0)
    return max(1, PASS_BYTES // (nodes * features_per_node(plan.subset, n_features) * width * 16))


def _open_rows(tree: G.Tree | None, nodes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which rows lie in an open node, the position of that node)."""
    if tree is None:
        return np.ones(codes.shape[1], bool), np.zeros(codes.shape[1], np.int64)
    slots = np.full(len(tree.node), -1)
    slots[np.searchsorted(tree.node, nodes)] = np.arange(len(nodes))
    slot = slots.take(tree.leaves(codes))
    some = slot >= 0
    return some, slot[some]


class _Counts:
    """Histograms of a tree's open nodes (``state``: the unfinished tree and its open nodes) while rows are added."""

    def __init__(self, state: tuple[G.Tree, np.ndarray] | None, choose, width: int):
        self.tree, self.nodes = state or (None, np.array([1]))
        self.width, self.features, self.steps = width, choose(self.nodes).astype(np.int64), 0
        if self.tree is not None:
            tree = self.tree
            self.slots = np.full(len(tree.node), -1)
            self.slots[np.searchsorted(tree.node, self.nodes)] = np.arange(len(self.nodes))
            if len(tree.node) <= 2 * LEVEL_NODES:       # where each code leads from each node; a leaf keeps its rows
                self.steps = int(tree.node[-1]).bit_length() - 1
                code, ends = np.arange(width), tree.left < 0
                left = np.where(code == 0, tree.missing_left[:, None], code <= tree.code[:, None])
                to = np.where(ends, np.arange(len(ends)), tree.left)[:, None] + np.where(ends[:, None], 0, ~left)
                self.to, self.feature = to.reshape(-1), np.where(ends, 0, tree.feature).astype(np.int64)
        self.paired = np.zeros((self.features.shape[1], len(self.nodes) * width))
        self.weight, self.whole = 0.0, None

    def add(self, codes: np.ndarray, rows: np.ndarray, both: np.ndarray) -> None:
        """Add the columns of ``codes``; ``both`` holds their statistics as one number each (:data:`growth.PAIRED`)."""
        n, flat = codes.shape[1], codes.reshape(-1)
        total = both.sum() % G.PAIRED
        if self.weight + total >= G.PAIRED:
            self.whole, self.weight = self.sums(), 0.0
            self.paired[:] = 0
        self.weight += total
        drawn = np.flatnonzero(both)
        rows, both = rows.take(drawn), both.take(drawn)
        slot = None
        if self.tree is not None:
            if self.steps:
                at, first = self.to.take(codes[self.feature[0]].take(rows)), self.feature * n
                for _ in range(self.steps - 1):
                    at = self.to.take(at * self.width + flat.take(first.take(at) + rows))
            else:
                at = self.tree.leaves(codes).take(rows)
            slot = self.slots.take(at)
            some = np.flatnonzero(slot >= 0)
            if len(some) < len(slot):
                slot, rows, both = slot.take(some), rows.take(some), both.take(some)
        first = 0 if slot is None else slot * self.width
        for j, out in enumerate(self.paired):
            feature = self.features[:, j]
            c = codes[feature[0]].take(rows) if slot is None else flat.take((feature * n).take(slot) + rows)
            out += np.bincount(first + c, both, minlength=len(out))

    def sums(self) -> np.ndarray:
        """[node, feature, code, statistic] sums, as whole numbers."""
        sums = self.paired.astype(np.int64).reshape(len(self.paired), len(self.nodes), self.width).transpose(1, 0, 2)
        out = np.stack([sums >> 26, sums & (int(G.PAIRED) - 1)], axis=-1)
        return out if self.whole is None else out + self.whole


def _tops(chunks: DataFrame, plan: Plan, trees: range, width: int, n_features: int, task_rows: int) -> dict[int, G.Frontier]:
    """Trees grown by levels to their end, or until every open node has at most ``task_rows`` drawn rows; a job per
    level for all of them."""
    from faultlens.operators.boosting import _unfinished
    spark = chunks.sparkSession
    mine = chunks.filter(F.col("unit") == plan.unit)
    fronts: dict[int, G.Frontier] = {}
    parked: dict[int, list[tuple]] = {t: [] for t in trees}          # open nodes that are small enough
    while True:
        partial = {}
        for t in trees:
            f = fronts.get(t)
            if f is None:
                partial[t] = None
            elif len(f.node):
                partial[t] = (_unfinished(_with(f, parked[t])), f.node)
        if not partial:
            break
        shared = spark.sparkContext.broadcast(partial)

        def sums(it):
            held: dict[int, _Counts] = {}
            for pdf in it:
                chunks = [_train(*x) for x in zip(*(pdf[c] for c in ("labels", "parts", "keys", "codes", "n")))]
                for at in range(0, len(chunks), BLOCK_CHUNKS):
                    c, k, y = (np.concatenate(x, axis=-1) for x in zip(*chunks[at:at + BLOCK_CHUNKS]))
                    rows, both = np.arange(len(y)), y * G.PAIRED + 1
                    for t, state in shared.value.items():
                        if t not in held:
                            held[t] = _Counts(state, _chooser(plan, t, n_features), width)
                        held[t].add(c, rows, both * G.bootstrap(k, plan.seed, t))
            for t, x in held.items():
                yield pd.DataFrame({"tree": np.int32(t), "part": (x.nodes // GROUP_NODES).astype(np.int64), "node": x.nodes,
                                    "hist": [h.tobytes() for h in x.sums()]})

        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            t = int(pdf["tree"].iloc[0])
            nodes, at = np.unique(pdf["node"].to_numpy(), return_inverse=True)
            subset = _chooser(plan, t, n_features)(nodes)
            hist = np.zeros((len(nodes), subset.shape[1] * width * 2), np.int64)
            for i, h in zip(at, pdf["hist"]):
                hist[i] += np.frombuffer(h, np.int64)
            hist = hist.astype(float).reshape(len(nodes), subset.shape[1], width, 2)
            s = G.best_splits(hist, RULE, subset)
            a, b = hist[:, 0].sum(axis=1).T
            return pd.DataFrame({"tree": np.int32(t), "node": nodes, "gain": s.gain, "feature": s.feature, "code": s.code,
                                 "missing_left": s.missing_left, "a": a, "b": b, "a_left": s.a_left, "b_left": s.b_left})

        got = mine.mapInPandas(sums, "tree int, part long, node long, hist binary").groupBy("tree", "part").applyInPandas(
            split, "tree int, node long, gain double, feature int, code int, missing_left boolean, a double, b double, "
                   "a_left double, b_left double").toPandas()
        shared.unpersist()
        for t, s in got.groupby("tree"):
            if t not in fronts:
                fronts[t] = G.Frontier(RULE, float(s["a"].iloc[0]), float(s["b"].iloc[0]))
            f = fronts[t]
            f.close(~RULE.open(f.a, f.b))
            s = s.set_index("node").loc[f.node]
            f.split(G.Splits(*(s[c].to_numpy() for c in ("gain", "feature", "code", "missing_left", "a_left", "b_left"))))
            if f.depth >= plan.depths[t]:
                f.close()
            if _by_levels(plan.depths[t]):
                continue
            ready = f.b <= task_rows
            parked[t] += list(zip(f.node[ready], f.a[ready], f.b[ready]))
            f.node, f.a, f.b = f.node[~ready], f.a[~ready], f.b[~ready]
    return {t: _with(f, parked[t]) for t, f in fronts.items()}


def _with(front: G.Frontier, more: list[tuple]) -> G.Frontier:
    """The frontier with the parked nodes among its open ones."""
    out = G.Frontier(front.rule, 0.0, 0.0, depth=front.depth)
    out.done = front.done
    rows = sorted([*zip(front.node, front.a, front.b), *more])
    out.node = np.array([r[0] for r in rows], np.int64)
    out.a, out.b = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    return out


# ---------------------------------------------------------------------------------- small nodes, one group each

# ``drawn``: per row a byte, twice the times it is drawn and its label.
_ROWS = "model int, tree int, root long, drawn binary, codes binary, n int"


def _finish(chunks: DataFrame, trees: dict[tuple[int, int], tuple[Plan, G.Frontier]], width: int, n_features: int) -> DataFrame:
    """Subtrees (rows of the trees table with their root) of every open node of the given trees."""
    from faultlens.operators.boosting import _unfinished
    spark = chunks.sparkSession
    schema = TREES + ", root long"
    if not trees:
        return spark.createDataFrame([], schema)
    units: dict[str, list] = {}
    for (model, t), (plan, f) in trees.items():
        units.setdefault(plan.unit, []).append((model, t, (_unfinished(f), f.node)))
    plans = {model: plan for (model, _), (plan, _) in trees.items()}
    shared = spark.sparkContext.broadcast((units, plans))

    def deal(it):
        units, plans = shared.value
        for pdf in it:
            for unit, labels, parts, keys, codes, n in zip(*(pdf[c] for c in ("unit", "labels", "parts", "keys", "codes", "n"))):
                c, k, y = _train(labels, parts, keys, codes, n)
                if not len(y):
                    continue
                out = []
                for model, t, (tree, nodes) in units.get(unit, ()):
                    times = G.bootstrap(k, plans[model].seed, t)
                    drawn = np.flatnonzero(times)
                    both = (2 * times + y).astype(np.uint8)
                    some, slot = _open_rows(tree, nodes, c[:, drawn])
                    rows = drawn[some]
                    order = np.argsort(slot, kind="stable")
                    cuts = np.searchsorted(slot[order], np.arange(len(nodes) + 1))
                    for node, i, j in zip(nodes, cuts[:-1], cuts[1:]):
                        if j > i:
                            pick = rows[order[i:j]]
                            out.append((model, t, int(node), both[pick].tobytes(), c[:, pick].tobytes(), j - i))
                    if len(out) >= 256:
                        yield pd.DataFrame(out, columns=["model", "tree", "root", "drawn", "codes", "n"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["model", "tree", "root", "drawn", "codes", "n"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        plan = shared.value[1][int(pdf["model"].iloc[0])]
        t, root = int(pdf["tree"].iloc[0]), int(pdf["root"].iloc[0])
        codes = np.concatenate([np.frombuffer(c, np.uint8).reshape(-1, n) for c, n in zip(pdf["codes"], pdf["n"])], axis=1)
        drawn = np.frombuffer(b"".join(pdf["drawn"]), np.uint8)
        b = (drawn >> 1).astype(float)
        a = b * (drawn & 1)
        tree = G.grow(codes, a, b, plan.depths[t], width, RULE, _chooser(plan, t, n_features), root, root.bit_length() - 1)
        return pd.DataFrame([{"model": plan.model, "tree": t, **tree.columns(), "auc": None, "root": root}])

    # Many small groups: no fewer tasks than the cluster works on at a time.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = chunks.filter(F.col("unit").isin(list(units))).mapInPandas(deal, _ROWS)
    return dealt.repartition(n, "model", "tree", "root").groupBy("model", "tree", "root").applyInPandas(finish, schema)


def _assembled(chunks: DataFrame, model: int, tops: dict[int, G.Frontier], below: DataFrame) -> DataFrame:
    """Top levels and subtrees joined to one row per tree; a subtree's root takes the place of the open node."""
    spark = chunks.sparkSession
    rows = []
    for t, f in tops.items():
        open_nodes = set(f.node.tolist())
        f.close()
        tree = f.tree()
        keep = np.array([x not in open_nodes for x in tree.node.tolist()], bool)
        rows.append((model, t, *[x[keep].tolist() for x in tree.columns().values()], None, 0))
    both = spark.createDataFrame(rows, TREES + ", root long").unionByName(below)
    nodes = both.select("model", "tree", F.explode(F.arrays_zip(*G.ARRAYS)).alias("x"))
    order = F.array_sort(F.collect_list("x"))        # by node, the first field
    whole = nodes.groupBy("model", "tree").agg(order.alias("x"))
    return whole.select("model", "tree", *[F.col(f"x.{c}").alias(c) for c in G.ARRAYS], F.lit(None).cast("double").alias("auc"))
