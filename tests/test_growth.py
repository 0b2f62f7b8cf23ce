"""The fast forms of the tree arithmetic against the plain ones, and the shape of fits of large tables."""

from pathlib import Path

import numpy as np
import pytest

from faultlens.operators import boosting as BO
from faultlens.operators import forest as FO
from faultlens.operators import growth as G


def level(rng, rule, n, slots, codes):
    """Rows of one level: (codes, slot, a, b)."""
    x = rng.integers(0, codes, (5, n)).astype(np.uint8)
    slot = np.concatenate([np.arange(slots), rng.integers(0, slots, n - slots)])
    if rule.counts:
        b = rng.integers(1, 4, n).astype(float)
        return x, slot, b * rng.integers(0, 2, n), b
    return x, slot, *G.gradients(rng.normal(size=n), rng.integers(0, 2, n).astype(float))


@pytest.mark.parametrize("rule", [G.Boosted(), G.Boosted(min_child=0.1), G.Gini()])
def test_splits_of_rows_equal_those_of_whole_histograms(rule):
    rng = np.random.default_rng(5)
    for n, slots, codes in ((300, 1, 9), (400, 40, 9), (90, 60, 4), (500, 20, 2), (60, 30, 1), (3000, 7, 20)):
        x, slot, a, b = level(rng, rule, n, slots, codes)
        for features in (None, np.sort(rng.permuted(np.tile(np.arange(5), (slots, 1)), axis=1)[:, :2], axis=1)):
            want = G.best_splits(G.histogram(x, slot, a, b, slots, 20, features), rule, features)
            got = G.row_splits(x, slot, a, b, slots, 20, rule, features)
            use = want.gain > 0
            assert (got.gain == want.gain).all()
            for name in ("feature", "code", "missing_left", "a_left", "b_left"):
                assert (getattr(got, name)[use] == getattr(want, name)[use]).all(), name


def test_counts_in_one_sum_equal_two_histograms():
    rng = np.random.default_rng(6)
    x, slot, a, b = level(rng, G.Gini(), 2000, 9, 20)
    features = np.sort(rng.permuted(np.tile(np.arange(5), (9, 1)), axis=1)[:, :2], axis=1)
    for b in (b, b * G.PAIRED):             # also where the counts are too large to share a number
        assert (G.count_histogram(x, slot, a, b, 9, 20, features) == G.histogram(x, slot, a, b, 9, 20, features)).all()


def test_a_walk_gives_the_nodes_of_every_depth():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 30, (4, 4000)).astype(np.uint8)
    x[:, :900][rng.random((4, 900)) < 0.4] = 0
    y = ((x[0] > 12) ^ (x[1] < 9) ^ (rng.random(4000) < 0.2)).astype(float)
    tree = G.grow(x, y, np.ones(4000), 14, 31, G.Gini())
    depths = [0, 1, 3, 8, 14]
    walked = [at.copy() for at in tree.walk(x, [*depths, None])]
    for r in range(0, 4000, 37):            # row by row
        path, at = [0], 0
        while tree.left[at] >= 0:
            c = x[tree.feature[at], r]
            at = tree.left[at] + (0 if (tree.missing_left[at] if c == 0 else c <= tree.code[at]) else 1)
            path.append(at)
        assert [w[r] for w in walked] == [path[min(d, len(path) - 1)] for d in depths] + [path[-1]]


def test_draws_equal_a_search_among_the_bounds():
    keys = np.random.default_rng(8).integers(-2 ** 62, 2 ** 62, 300_000)
    u = (G._mixed(keys.view(np.uint64) ^ G._stream(42, 3)) >> np.uint64(11)).astype(float) / float(1 << 53)
    assert (G.bootstrap(keys, 42, 3) == np.searchsorted(G._POISSON, u, side="right")).all()


def test_shallow_trees_of_a_large_table_share_their_passes_and_need_no_rows():
    plan = lambda depth: FO.Plan(0, "", 42, "sqrt", (depth,) * 1000)
    assert FO._by_levels(5) and not FO._by_levels(28)
    for rows in (10 ** 7, 10 ** 9):         # 63 passes of 16 trees before
        assert FO._trees_per_pass(plan(5), rows, 129, 7, BO.rows_per_task(7)) >= 500
    assert 1 <= FO._trees_per_pass(plan(28), 10 ** 9, 129, 7, BO.rows_per_task(7)) < 500
    # The rows of one task are bounded by their bytes.
    for n in (1, 7, 88):
        assert BO.rows_per_task(n) * (n + BO.ROW_BYTES) <= BO.TASK_BYTES


def test_counts_grow_the_trees_that_whole_levels_give():
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 9, (5, 3000)).astype(np.uint8)
    y = ((codes[0] > 4) ^ (rng.random(3000) < 0.2)).astype(float)
    w = G.bootstrap(rng.integers(-2**62, 2**62, 3000), 3, 1)
    choose = lambda nodes: G.feature_subsets(nodes, 5, 2, 3, 1)     # noqa: E731
    for depth in (0, 1, 4, 12):
        tree = G._grow_counts(codes, y * w, w, depth, 10, G.Gini(), choose, 1, 0)
        front, at = G.Frontier(G.Gini(), float((y * w).sum()), float(w.sum())), np.zeros(3000, np.int64)
        while len(front.node):
            if front.depth >= depth:
                front.close()
                break
            front.close(~front.rule.open(front.a, front.b))
            if not len(front.node):
                break
            at = tree.node[tree.leaves(codes, front.depth)]
            slot = np.searchsorted(front.node, at)
            some = (slot < len(front.node)) & (front.node[np.minimum(slot, len(front.node) - 1)] == at)
            subset = choose(front.node)
            hist = G.histogram(codes[:, some], slot[some], (y * w)[some], w[some], len(front.node), 10, subset)
            front.split(G.best_splits(hist, G.Gini(), subset))
        for a, b in zip(tree.columns().values(), front.tree().columns().values()):
            assert np.array_equal(a, b)


def test_deep_forests_in_bounded_passes(spark, monkeypatch):
    """A deep forest whose rows are dealt and judged in many small passes is the one that is grown and judged at once."""
    from faultlens.operators import ensemble as EN
    from faultlens.operators import forest as FO
    from faultlens.operators import models as M
    from faultlens.operators import tuning as TU
    from faultlens.session import shared_dir
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4)).round(1)
    y = (x[:, 0] * x[:, 1] + rng.normal(size=3000) * 0.5 > 0).astype(int)
    split = spark.createDataFrame([(str(i), int(b), *map(float, r), i % 5 == 0) for i, (r, b) in enumerate(zip(x, y))],
                                  "ESN string, label int, a double, b double, c double, d double, holdout boolean").repartition(4)
    specs = [M.ModelSpec("forest", 9, 12), M.ModelSpec("forest", 20, 7)]
    bins, chunks = M.coded(split, list("abcd"), specs[0])
    rows = lambda f: sorted((r["tree"], *map(tuple, r[2:9])) for r in f.trees.collect())      # noqa: E731
    whole = TU.grow_for(chunks, bins, specs, 300)
    scores = {r["ESN"]: r["score"] for r in whole.score(split).collect()}
    aucs = TU.cut_aucs(chunks, whole, specs)
    asked = []
    monkeypatch.setattr(FO, "DEAL_BYTES", 30_000)
    monkeypatch.setattr(EN, "SHUFFLE_BYTES", 0)
    monkeypatch.setattr(EN, "PASS_NODES", 1000)
    monkeypatch.setattr(FO, "_finish", lambda *a, f=FO._finish: asked.append(len(a[1])) or f(*a))
    cut = TU.grow_for(chunks, bins, specs, 300)
    assert len(asked) >= 4 and max(asked) < 12 and rows(cut) == rows(whole)
    sums = Path(shared_dir(spark, "model/sums").removeprefix("file:"))
    assert TU.cut_aucs(chunks, cut, specs) == pytest.approx(aucs, abs=1e-12)
    assert sums.exists() and not list(sums.iterdir())
    got = {r["ESN"]: r["score"] for r in cut.score(split).collect()}
    assert got.keys() == scores.keys() and all(abs(got[k] - scores[k]) < 1e-12 for k in scores)
