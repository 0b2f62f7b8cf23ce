"""Boosting rounds over remembered nodes and forest counts over blocks against the plain growth of a tree."""

import numpy as np
import pytest

from faultlens.operators import boosting as BO
from faultlens.operators import forest as FO
from faultlens.operators import growth as G
from faultlens.operators import shards as SH
from faultlens.operators.binning import JUDGED, TRAIN
from faultlens.operators.models import ModelSpec


def table(n, codes=(3, 12, 40, 9, 5), seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, k, n) for k in codes]).astype(np.uint8)
    x[:, rng.random(n) < 0.1] = 0
    y = ((x[2] > 17) ^ (x[1] < 4) ^ (rng.random(n) < 0.15)).astype(float)
    return x, y, (rng.random(n) < 0.2).astype(np.uint8)


@pytest.mark.parametrize("depth,min_child", [(0, 1.0), (1, 1.0), (5, 1.0), (9, 0.05)])
def test_remembered_nodes_give_the_trees_of_a_plain_growth(monkeypatch, depth, min_child):
    monkeypatch.setattr(SH, "BLOCK_ROWS", 700)          # several blocks
    x, y, part = table(5000)
    spec = ModelSpec(max_depth=depth, n_trees=6, min_child_weight=min_child, early_stopping=0)
    margin, own = np.zeros(len(y)), part == TRAIN
    got = list(BO.boost(x, y, part, spec, 64))
    assert len(got) == 6
    for row in got:
        want = G.grow(x[:, own], *G.gradients(margin[own], y[own]), depth, 64, BO.rule_of(spec))
        for c, v in want.columns().items():
            assert (row[c] == v).all(), c
        margin += want.value[want.leaves(x)]
        assert row["auc"] == G.exact_auc(margin[part == JUDGED], y[part == JUDGED])
    more = list(BO.boost(x, y, part, spec.with_params(n_trees=8), 64, got))      # going on from earlier trees
    assert [list(r["node"]) for r in more[:6]] == [list(r["node"]) for r in got]
    whole = list(BO.boost(x, y, part, spec.with_params(n_trees=8), 64))
    assert all((a["value"] == b["value"]).all() for a, b in zip(more, whole))


def test_features_of_few_codes_are_summed_together():
    assert sorted(map(sorted, SH.bundles([11, 11, 125, 9, 9, 75, 120]))) == [[0, 2], [1, 6], [3, 5], [4]]
    for radix in ([129] * 16, [2] * 30, [1], []):
        groups = SH.bundles(radix)
        assert sorted(f for g in groups for f in g) == list(range(len(radix)))
        assert all(len(g) == 1 or np.prod([radix[f] for f in g]) <= SH.BUNDLE_CELLS for g in groups)


@pytest.mark.parametrize("paired", [G.PAIRED, 3000.0])       # also where the counts are passed on before they are too large
def test_forest_counts_over_blocks_are_those_of_whole_histograms(monkeypatch, paired):
    x, y, _ = table(6000)
    keys = np.random.default_rng(4).integers(-2 ** 62, 2 ** 62, 6000)
    plan = FO.Plan(0, "", 42, "sqrt", (4,))
    choose = FO._chooser(plan, 0, len(x))
    a, b = FO._weighted(plan, 0, keys, y)
    tree = G.grow(x, a, b, 3, 64, FO.RULE, choose)
    nodes = tree.node[(tree.feature < 0) & (tree.node >= 8)]
    for state in (None, (tree, nodes)):
        counts = FO._Counts(state, choose, 64)
        flushed = []
        for at in range(0, 6000, 1000):
            part = slice(at, at + 1000)
            if paired != G.PAIRED and counts.weight > paired:
                flushed.append(at)
                counts.weight = G.PAIRED            # the next block does not fit any more
            counts.add(np.ascontiguousarray(x[:, part]), np.arange(1000), (y[part] * G.PAIRED + 1) * G.bootstrap(keys[part], 42, 0))
        own = np.array([1]) if state is None else nodes
        some, slot = FO._open_rows(state and state[0], own, x)
        want = G.histogram(x[:, some], slot, a[some], b[some], len(own), 64, choose(own))
        assert (counts.sums() == want).all()
        assert bool(flushed) == (paired != G.PAIRED) and (counts.whole is not None) == bool(flushed)


def test_rounds_that_cannot_stop_a_fit_are_judged_together():
    """A job per round before."""
    fit = object.__new__(BO._Levels)

    def unjudged(aucs, **spec):
        fit.members = {0: BO.Member(0, "", ModelSpec(**spec))}
        fit.aucs, fit.trees = {0: aucs}, {0: [None] * len(aucs)}
        return fit._unjudged([0])

    assert unjudged([], early_stopping=100) == BO.WRITE_ROUNDS and unjudged([], early_stopping=5) == 6
    assert unjudged([0.5, 0.7, 0.6], early_stopping=5) == 4         # the best, round 2, is 5 rounds old in round 7
    assert unjudged([0.5] * 98, early_stopping=100) == 3            # stops in round 101: no round more
    assert unjudged([0.5] * 98, n_trees=99) == 1 and unjudged([], n_trees=9, early_stopping=0) == 9


def test_a_task_reads_few_chunks_at_once(spark):
    from faultlens.operators import binning
    df = spark.range(0, 100, 1, 1)
    batches = lambda: [r["n"] for r in df.mapInPandas(lambda it: (p.iloc[:1].assign(n=len(p))[["n"]] for p in it), "n int").collect()]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with binning.chunk_batches(spark):
        assert max(batches()) <= binning.BATCH_CHUNKS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_states_of_a_large_fit_go_and_rounds_are_judged_in_parts(spark, monkeypatch):
    """Rounds judged few at a time have the same AUCs; nothing of the fit stays cached or written but its trees."""
    from pathlib import Path
    from faultlens.operators import models as M
    from faultlens.session import shared_dir
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 3)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=2000) > 0).astype(int)
    split = spark.createDataFrame([(str(i), int(b), *map(float, r), i % 4 == 0) for i, (r, b) in enumerate(zip(x, y))],
                                  "ESN string, label int, a double, b double, c double, holdout boolean").repartition(4)
    specs = [M.ModelSpec("boosted", d, n, early_stopping=p) for d, n, p in ((3, 5, 0), (2, 3, 2))]
    bins, chunks = M.coded(split, list("abc"), specs[0])
    models = {i: ("", s) for i, s in enumerate(specs)}
    whole = M.fit_chunks(chunks, bins, models, 10**6)
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    judged = Path(shared_dir(spark, "roc/grouped").removeprefix("file:"))
    before = list(judged.iterdir()) if judged.exists() else []
    parts = []
    monkeypatch.setattr(BO, "WRITE_ROUNDS", 2)
    monkeypatch.setattr(BO, "JUDGE_BYTES", 1)
    monkeypatch.setattr(BO._Levels, "_judge_some", lambda self, s, new, pairs, f=BO._Levels._judge_some: parts.append(pairs) or f(self, s, new, pairs))
    got = M.fit_chunks(chunks, bins, models, 100)
    assert all(len(p) == 1 for p in parts) and len(parts) >= len(got[0].aucs)
    for a, b in zip(got, whole):
        assert a.aucs == pytest.approx(b.aucs, abs=1e-12) and a.n_trees == b.n_trees
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached
    folders = [Path(shared_dir(spark, x).removeprefix("file:")) for x in ("model/state", "roc/grouped")]
    assert [list(f.iterdir()) if f.exists() else [] for f in folders] == [[], before]
    more = M.more_rounds(got[1].__class__(**{**got[1].__dict__, "spec": specs[1].with_params(early_stopping=0)}), split, 4, 100)
    assert len(more.aucs) == 4 and more.aucs[:len(got[1].aucs)] == pytest.approx(got[1].aucs, abs=1e-12)
