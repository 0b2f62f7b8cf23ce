"""Boosted trees: second-order logistic boosting with early stopping, for many models at once.

Models (tuning trials, scenarios) are fitted together.  A model whose training table is small
(:func:`rows_per_task`) is one group of a Spark job: all such models take one job, however many they are.
A larger one is grown level by level over its chunks: tasks add up histograms keyed by (model, node),
the sums meet per node, the best split of a node is found where they meet, and only splits reach
the driver; one job per level serves all large models.  Margins are kept as the state of the chunks
and advance by one tree per round, so each round is fitted once and a fit can go on from its trees.
Both ways give the same trees: sums are exact (:mod:`faultlens.operators.growth`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.operators import growth as G
from faultlens.operators.binning import JUDGED, TRAIN, chunk_batches
from faultlens.operators.roc import grouped_auc_of_counts
from faultlens.operators.shards import Grower, Shard
from faultlens.session import discard, scratch_scope, ship_package, shuffles_dropped, unique_dir
from faultlens.sources.sinks import materialize

# Training tables of up to so many bytes while they are fitted (coded rows, with what a fit holds beside a
# row's codes) are one task's group, and those of up to TASK_ROWS rows, however wide.
TASK_ROWS = 1 << 18
TASK_BYTES = 1 << 26
ROW_BYTES = 56
# Rounds after which the state of a large fit is written, which cuts its lineage.
WRITE_ROUNDS = 16
# Bytes of the state in a partition.
STATE_BYTES = 1 << 27
# Bytes of scores that the judging of rounds may shuffle at a time, and bytes of a score with its counts.
JUDGE_BYTES = 1 << 30
SCORE_BYTES = 40
TREES = "model int, tree int, " + ", ".join(f"{c} array<{t}>" for c, t in G.ARRAYS.items()) + ", auc double"


@dataclass(frozen=True)
class Member:
    """One model of a joint fit: its number, the unit (training table) of its chunks, and its ModelSpec."""
    model: int
    unit: str
    spec: object


def best_round(aucs: list[float], patience: int) -> tuple[int, int, bool]:
    """(best round, last round, stopped): the first round of the highest AUC, counted from 1,
    as known when it first was ``patience`` rounds old or when the rounds ended."""
    best = 1
    for i, a in enumerate(aucs, start=1):
        if a > aucs[best - 1]:
            best = i
        elif patience and i - best >= patience:
            return best, i, True
    return best, len(aucs), False


def rule_of(spec) -> G.Boosted:
    return G.Boosted(spec.step_size, spec.l2, spec.min_child_weight)


def unit_rows(chunks: DataFrame) -> dict[str, int]:
    """Rows of every unit (one row per unit reaches the driver)."""
    return {r["unit"]: r["n"] for r in chunks.groupBy("unit").agg(F.sum("n").alias("n")).collect()}


def rows_per_task(n_features: int) -> int:
    """Rows of this many features that one task may fit by itself."""
    return max(TASK_ROWS, TASK_BYTES // (n_features + ROW_BYTES))


def fit_boosted(chunks: DataFrame, members: list[Member], width: int, task_rows: int,
                start: DataFrame | None = None) -> DataFrame:
    """The trees table of all members (a row per model and tree), written once.

    ``auc`` is the model's validation AUC after the tree (null without judged rows of both
    classes; with early stopping that is an error).  ``start`` holds trees of earlier rounds of the
    same members; the fit goes on after them and returns them too.
    """
    ship_package(chunks.sparkSession)
    rows = unit_rows(chunks)
    small = [m for m in members if rows.get(m.unit, 0) <= task_rows]
    large = [m for m in members if rows.get(m.unit, 0) > task_rows]
    parts = []
    if small:
        parts.append(_fit_in_tasks(chunks, small, width, start))
    if large:
        with chunk_batches(chunks.sparkSession), shuffles_dropped(chunks.sparkSession):
            parts.append(_Levels(chunks, large, width, start).fit())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out, "model/trees")


# ---------------------------------------------------------------------------------- one model, one group

def members_frame(chunks: DataFrame, members: list[Member]) -> DataFrame:
    rows = [(m.model, m.unit, json.dumps(asdict(m.spec))) for m in members]
    return chunks.sparkSession.createDataFrame(rows, "model int, unit string, spec string")


def _fit_in_tasks(chunks: DataFrame, members: list[Member], width: int, start: DataFrame | None) -> DataFrame:
    # More partitions than models, so that few models share a task; groups of different models are independent.
    n = min(4 * len(members), 4096)
    rows = chunks.join(members_frame(chunks, members), "unit").repartition(n, "model")
    fit = _group_fit(width)
    if start is None:
        return rows.groupBy("model").applyInPandas(lambda pdf: fit(pdf, None), TREES)
    known = start.filter(F.col("model").isin([m.model for m in members])).repartition(n, "model")
    return rows.groupBy("model").cogroup(known.groupBy("model")).applyInPandas(fit, TREES)


def joined_codes(codes: list[bytes], sizes: list[int]) -> np.ndarray:
    """[feature, row] codes of several chunks side by side."""
    return np.concatenate([np.frombuffer(c, np.uint8).reshape(-1, n) for c, n in zip(codes, sizes)], axis=1)


def _group_fit(width: int):
    def fit(pdf: pd.DataFrame, known: pd.DataFrame | None) -> pd.DataFrame:
        from faultlens.operators.models import ModelSpec
        if pdf.empty:
            return known
        spec = ModelSpec(**json.loads(pdf["spec"].iloc[0]))
        codes = joined_codes(pdf["codes"].tolist(), pdf["n"].tolist())
        y = np.frombuffer(b"".join(pdf["labels"]), np.uint8).astype(float)
        part = np.frombuffer(b"".join(pdf["parts"]), np.uint8)
        before = [] if known is None or known.empty else known.sort_values("tree").to_dict("records")
        rows = [{**r, "model": int(pdf["model"].iloc[0])} for r in boost(codes, y, part, spec, width, before)]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in TREES.split(", ")])
    return fit


def boost(codes: np.ndarray, y: np.ndarray, part: np.ndarray, spec, width: int, before=()) -> Iterator[dict]:
    """Rows (tree, arrays, auc) of a model fitted in memory, the given earlier trees first."""
    shard = Shard(codes, y, part)
    grower = Grower(shard, rule_of(spec), spec.max_depth, width)
    truth, aucs = shard.labels[JUDGED].astype(float), []
    for t in range(spec.n_trees):
        if _stopped(aucs, spec):
            return
        if t < len(before):
            row = {c: before[t][c] for c in ("tree", *G.ARRAYS)}
            grower.follow(G.tree_of(row))
        else:
            row = {"tree": t, **grower.grow().columns()}
        auc = G.exact_auc(grower.margins[JUDGED], truth) if len(truth) else None
        if auc is None and spec.early_stopping:
            raise ValueError("early stopping needs validation rows of both classes")
        aucs.append(auc)
        yield {**row, "auc": auc}


def _stopped(aucs: list, spec) -> bool:
    return bool(spec.early_stopping and aucs and best_round(aucs, spec.early_stopping)[2])


# ---------------------------------------------------------------------------------- large models, level by level

_STATE = "unit string, n int, labels binary, parts binary, codes binary, margins binary"
_HIST = "model int, node long, hist binary"
_SPLIT = "model int, node long, gain double, feature int, code int, missing_left boolean, a double, b double, a_left double, b_left double"


class _Levels:
    """Joint level-by-level fit.  ``margins`` of a chunk holds one row of doubles per model of its unit."""

    def __init__(self, chunks: DataFrame, members: list[Member], width: int, start: DataFrame | None):
        self.spark, self.width = chunks.sparkSession, width
        self.members = {m.model: m for m in members}
        self.units: dict[str, list[int]] = {}
        for m in members:
            self.units.setdefault(m.unit, []).append(m.model)
        units = self.units
        self.trees: dict[int, list[G.Tree]] = {m: [] for m in self.members}
        self.aucs: dict[int, list[float]] = {m: [] for m in self.members}
        self.paths: dict[DataFrame, str] = {}       # of the states that are written, the others are cached
        own = chunks.filter(F.col("unit").isin(list(units))).drop("keys")
        count = lambda it: (pd.DataFrame({"judged": [sum(p.count(JUDGED) for p in x["parts"])],      # noqa: E731
                                          "bytes": [sum(len(c) + n * 8 * len(units[u]) for u, n, c in zip(x["unit"], x["n"], x["codes"]))]}) for x in it)
        self.judged, size = (x or 0 for x in own.mapInPandas(count, "judged long, bytes long").agg(F.sum("judged"), F.sum("bytes")).first())
        # The same number of chunks for every core, and partitions that are read and cached piece by piece.
        cores = self.spark.sparkContext.defaultParallelism
        self.state = self._cached(own.repartition(cores * max(1, -(-size // (cores * STATE_BYTES)))).mapInPandas(
            lambda it: (p.assign(margins=[np.zeros((len(units[u]), n)).tobytes() for u, n in zip(p["unit"], p["n"])]) for p in it), _STATE))
        self.start = start

    @staticmethod
    def _cached(state: DataFrame) -> DataFrame:
        """The state on the executors' disks, made by a job of its own: no task has the Python of two steps at a time."""
        state = state.persist(StorageLevel.DISK_ONLY)
        state.count()
        return state

    def _drop(self, state: DataFrame) -> None:
        if state in self.paths:
            discard(self.spark, self.paths.pop(state))
        else:
            state.unpersist()

    def fit(self) -> DataFrame:
        before = self.state
        try:
            if self.start is not None:
                self._resume()
                self._drop(before)
            rounds = max(len(t) for t in self.trees.values())
            while True:
                active = [m for m, x in self.members.items()
                          if len(self.trees[m]) == rounds < x.spec.n_trees and not _stopped(self.aucs[m], x.spec)]
                if not active:
                    break
                # As many rounds as surely count are judged together, by the state before them.
                before, first = self.state, rounds
                for rounds in range(first + 1, first + 1 + self._unjudged(active)):
                    growing = [m for m in active if rounds <= self.members[m].spec.n_trees]
                    last = self.state
                    self._advance(self._round(growing), write=rounds % WRITE_ROUNDS == 0)
                    if last is not before:
                        self._drop(last)
                aucs = self._judge(before, {m: self.trees[m][first:] for m in active})
                for m in active:
                    for t in range(first, len(self.trees[m])):
                        if aucs.get((m, t)) is None and self.members[m].spec.early_stopping:
                            raise ValueError("early stopping needs validation rows of both classes")
                        self.aucs[m].append(aucs.get((m, t)))
                self._drop(before)
        finally:
            before.unpersist()
            self._drop(self.state)
        rows = [(m, t, *[x.tolist() for x in tree.columns().values()], self.aucs[m][t])
                for m, trees in self.trees.items() for t, tree in enumerate(trees)]
        return self.spark.createDataFrame(rows, TREES)

    def _unjudged(self, active: list[int]) -> int:
        """Rounds before any of the active models can stop: none is grown in vain."""
        left = [max(self.members[m].spec.n_trees for m in active) - len(self.trees[active[0]]), WRITE_ROUNDS]
        for m in active:
            patience = self.members[m].spec.early_stopping
            if patience:
                seen = self.aucs[m]
                left.append((best_round(seen, patience)[0] + patience if seen else 1 + patience) - len(seen))
        return max(1, min(left))

    def _resume(self) -> None:
        rows = self.start.filter(F.col("model").isin(list(self.members))).orderBy("model", "tree").collect()
        new: dict[int, list[G.Tree]] = {}
        for r in rows:
            new.setdefault(r["model"], []).append(G.tree_of(r))
            self.aucs[r["model"]].append(r["auc"])
        self._advance(new, write=True)

    def _round(self, active: list[int]) -> dict[int, list[G.Tree]]:
        """One more tree of every active model, all of them one job per level."""
        fronts: dict[int, G.Frontier] = {}
        depth = 0
        while True:
            growing = {m: fronts.get(m) for m in active if m not in fronts or
                       len(fronts[m].node) and depth < self.members[m].spec.max_depth}
            if not growing:
                break
            got = self._level(growing)
            for m in growing:
                s = got[m]
                if m not in fronts:
                    fronts[m] = G.Frontier(rule_of(self.members[m].spec), float(s["a"].iloc[0]), float(s["b"].iloc[0]))
                front = fronts[m]
                ends = ~front.rule.open(front.a, front.b)
                front.close(ends)
                s = s.set_index("node").loc[front.node]
                front.split(G.Splits(*(s[c].to_numpy() for c in ("gain", "feature", "code", "missing_left", "a_left", "b_left"))))
            depth += 1
        for f in fronts.values():
            f.close()
        return {m: [f.tree()] for m, f in fronts.items()}

    def _level(self, growing: dict[int, G.Frontier | None]) -> dict[int, pd.DataFrame]:
        """Best split of every open node (a row per node reaches the driver)."""
        partial = {m: (_unfinished(f), f.node) if f else None for m, f in growing.items()}
        shared = self.spark.sparkContext.broadcast((partial, self.units, {m: rule_of(self.members[m].spec) for m in growing}))
        width = self.width

        def sums(it):
            partial, units, _ = shared.value
            held: dict[int, np.ndarray] = {}
            for pdf in it:
                for unit, n, labels, parts, codes, margins in zip(*(pdf[c] for c in (
                        "unit", "n", "labels", "parts", "codes", "margins"))):
                    train = np.frombuffer(parts, np.uint8) == TRAIN
                    c = np.frombuffer(codes, np.uint8).reshape(-1, n)[:, train]
                    y = np.frombuffer(labels, np.uint8)[train].astype(float)
                    margin = np.frombuffer(margins).reshape(-1, n)[:, train]
                    for i, m in enumerate(units[unit]):
                        if m not in partial:
                            continue
                        a, b = G.gradients(margin[i], y)
                        if partial[m] is None:
                            slot, slots, some = np.zeros(len(a), np.int64), 1, slice(None)
                        else:
                            tree, open_nodes = partial[m]
                            slots = len(open_nodes)
                            place = np.full(len(tree.node), -1)
                            place[np.searchsorted(tree.node, open_nodes)] = np.arange(slots)
                            slot = place.take(tree.leaves(c))
                            some = slot >= 0
                            slot = slot[some]
                        h = G.histogram(c[:, some], slot, a[some], b[some], slots, width)
                        held[m] = held[m] + h if m in held else h
            for m, h in held.items():
                nodes = [1] if partial[m] is None else partial[m][1].tolist()
                yield pd.DataFrame({"model": m, "node": nodes, "hist": [x.astype(np.int64).tobytes() for x in h]})

        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            rule = shared.value[2][int(pdf["model"].iloc[0])]
            total = sum(np.frombuffer(h, np.int64) for h in pdf["hist"]).astype(float)
            hist = total.reshape(1, -1, width, 2)
            s = G.best_splits(hist, rule)
            a, b = hist[0, 0].sum(axis=0)
            return pd.DataFrame({"model": pdf["model"].iloc[:1], "node": pdf["node"].iloc[:1], "gain": s.gain, "feature": s.feature,
                                 "code": s.code, "missing_left": s.missing_left, "a": a, "b": b, "a_left": s.a_left, "b_left": s.b_left})

        out = self.state.mapInPandas(sums, _HIST).groupBy("model", "node").applyInPandas(split, _SPLIT).toPandas()
        return {m: g for m, g in out.groupby("model")}

    def _advance(self, new: dict[int, list[G.Tree]], write: bool) -> None:
        """Add the new trees to the margins and to the models."""
        shared = self.spark.sparkContext.broadcast((new, self.units))

        def add(it):
            new, units = shared.value
            for pdf in it:
                out = []
                for unit, n, codes, margins in zip(pdf["unit"], pdf["n"], pdf["codes"], pdf["margins"]):
                    c = np.frombuffer(codes, np.uint8).reshape(-1, n)
                    m = np.frombuffer(margins).reshape(-1, n).copy()
                    for i, model in enumerate(units[unit]):
                        for tree in new.get(model, ()):
                            m[i] += tree.value[tree.leaves(c)]
                    out.append(m.tobytes())
                yield pdf.assign(margins=out)

        state = self.state.mapInPandas(add, _STATE)
        if write:
            path = unique_dir(self.spark, "model/state")
            state.write.parquet(path)
            self.state = self.spark.read.schema(_STATE).parquet(path)
            self.paths[self.state] = path
        else:
            self.state = self._cached(state)
        shared.unpersist()
        for m, trees in new.items():
            self.trees[m] += trees

    def _judge(self, state: DataFrame, new: dict[int, list[G.Tree]]) -> dict[tuple[int, int], float | None]:
        """Validation AUC per (model, tree) of the new trees, which come after ``state``, from counts per score that the
        tasks have added up; so many trees at a time that their scores are ``JUDGE_BYTES``."""
        pairs = [(m, t) for m, trees in new.items() for t in range(len(trees))]
        most = max(1, JUDGE_BYTES // max(1, self.judged * SCORE_BYTES))
        out: dict[tuple[int, int], float | None] = {}
        for at in range(0, len(pairs), most):
            out |= self._judge_some(state, new, pairs[at:at + most])
        return out

    def _judge_some(self, state: DataFrame, new: dict[int, list[G.Tree]], pairs: list[tuple[int, int]]) -> dict[tuple[int, int], float | None]:
        wanted: dict[int, list[int]] = {}
        for m, t in pairs:
            wanted.setdefault(m, []).append(t)
        units = {u: [(i, m) for i, m in enumerate(ms) if m in wanted] for u, ms in self.units.items()}
        trees = {m: new[m][:max(ts) + 1] for m, ts in wanted.items()}
        shared = self.spark.sparkContext.broadcast((trees, units, {m: (min(ts), len(self.aucs[m])) for m, ts in wanted.items()}))

        def counts(it):
            trees, units, first = shared.value
            for pdf in it:
                for unit, own in pdf.groupby("unit"):
                    picks = [np.frombuffer(p, np.uint8) == JUDGED for p in own["parts"]]
                    y = np.concatenate([np.frombuffer(x, np.uint8)[p] for x, p in zip(own["labels"], picks)])
                    c = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, len(p))[:, p] for x, p in zip(own["codes"], picks)], axis=1)
                    for i, m in units[unit]:
                        margin = np.concatenate([np.frombuffer(x).reshape(-1, len(p))[i, p] for x, p in zip(own["margins"], picks)])
                        least, before = first[m]
                        for t, tree in enumerate(trees[m]):
                            margin += tree.value[tree.leaves(c)]
                            if t < least:
                                continue
                            value, at = np.unique(margin, return_inverse=True)
                            pos = np.bincount(at, y, minlength=len(value)).astype(np.int64)
                            yield pd.DataFrame({"round": np.int64(m) << 32 | (before + t), "score": value, "pos": pos,
                                                "neg": np.bincount(at, minlength=len(value)) - pos})

        scored = state.mapInPandas(counts, "round long, score double, pos long, neg long").groupBy("round", "score").agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        with scratch_scope(self.spark):
            out = {(r["round"] >> 32, r["round"] & 0xFFFFFFFF): r["auc"] for r in grouped_auc_of_counts(scored, "round").collect()}
        shared.unpersist()
        return out


def _unfinished(front: G.Frontier) -> G.Tree:
    """The settled nodes and the open ones as leaves."""
    n = len(front.node)
    extra = (front.node, np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n), front.a, front.b)
    cols = [np.concatenate(x) for x in zip(*front.done, extra)]
    order = np.argsort(cols[0], kind="stable")
    node, feature, code, missing_left, gain, _, b = (c[order] for c in cols)
    return G.Tree(node, feature, code, missing_left, gain, np.zeros(len(node)), b)
