"""The tree engine: exact splits, equal trees in every way of growing them, early stopping, cuts, scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens import schemas as S
from faultlens.operators import binning as B
from faultlens.operators import boosting as BO
from faultlens.operators import forest as FO
from faultlens.operators import growth as G
from faultlens.operators import models as M
from faultlens.operators import roc as R
from faultlens.operators import tuning as TU
from faultlens.plans.training import split_table
from faultlens.sources import testmap as T

from fixture_paths import SF001, SF0001

SIGNAL = ["l_discount_max", "l_discount_min", "l_discount_std",
          "l_tax_max", "l_tax_min", "l_tax_avg", "l_tax_std"]
NOISE = ["l_tax_max", "l_tax_min", "l_tax_avg", "l_tax_std"]


@pytest.fixture(scope="module")
def split(spark):
    s = split_table(T.model_matrix_source(spark, SF001), S.feature_columns(T.MATRIX_MEASURES), 0.2, 42).persist()
    yield s
    s.unpersist()


@pytest.fixture(scope="module")
def small(spark):
    s = split_table(T.model_matrix_source(spark, SF0001), SIGNAL, 0.2, 42).persist()
    yield s
    s.unpersist()


def trees_of(fitted):
    return fitted.trees.orderBy("tree").drop("model").collect()


def jobs_of(spark, run):
    """(result, number of Spark jobs) of a call."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    before = len(sc.statusTracker().getJobIdsForGroup("counted"))
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


# ---------------------------------------------------------------------------------- splits

def brute_split(codes, a, b, rule, features, width):
    """Best (gain, feature, code, missing left) by trying every split of every feature."""
    best = (0.0, -1, 0, False)
    for f in sorted(features):
        for c in range(1, width):
            for left_missing in (False, True):
                left = np.where(codes[f] == 0, left_missing, codes[f] <= c)
                al, bl, ar, br = a[left].sum(), b[left].sum(), a[~left].sum(), b[~left].sum()
                if rule.allowed(np.array(bl)) and rule.allowed(np.array(br)):
                    gain = float(rule.score(al, bl) + rule.score(ar, br) - rule.score(a.sum(), b.sum()))
                    if gain > G.LEAST_GAIN and gain > best[0] + 1e-12:
                        best = (gain, f, c, left_missing)
    return best


@pytest.mark.parametrize("rule", [G.Boosted(), G.Boosted(l2=5.0, min_child=3.0), G.Gini()])
def test_splits_equal_a_search_over_all_splits(rule):
    rng = np.random.default_rng(3)
    for _ in range(25):
        codes = rng.integers(0, 6, (4, 60)).astype(np.uint8)
        if isinstance(rule, G.Gini):
            b = rng.integers(0, 4, 60).astype(float)
            a = b * rng.integers(0, 2, 60)
        else:
            a, b = G.gradients(rng.normal(size=60), rng.integers(0, 2, 60).astype(float))
        features = np.array([[0, 1, 2, 3], [0, 2, 2, 3]])[:1]
        s = G.best_splits(G.histogram(codes, np.zeros(60, int), a, b, 1, 7, features), rule, features)
        gain, f, c, left_missing = brute_split(codes, a, b, rule, range(4), 7)
        assert s.gain[0] == pytest.approx(gain, abs=1e-9)
        if gain:
            left = np.where(codes[s.feature[0]] == 0, s.missing_left[0], codes[s.feature[0]] <= s.code[0])
            assert (s.a_left[0], s.b_left[0]) == (a[left].sum(), b[left].sum())
            assert (f, c, left_missing) == (s.feature[0], s.code[0], s.missing_left[0])


def test_leaf_weights_are_newton_steps():
    """value = -step x gradient sum / (Hessian sum + l2), from the rows of each leaf."""
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 9, (3, 400)).astype(np.uint8)
    y = (codes[0] > 4).astype(float)
    margin = rng.normal(size=400)
    rule = G.Boosted(step=0.3, l2=1.0)
    tree = G.grow(codes, *G.gradients(margin, y), 4, 10, rule)
    p = 1 / (1 + np.exp(-margin))
    at = tree.leaves(codes)
    for leaf in np.unique(at):
        rows = at == leaf
        g, h = (p - y)[rows].sum(), (p * (1 - p))[rows].sum()
        assert tree.value[leaf] == pytest.approx(-0.3 * g / (h + 1.0), abs=1e-4)
        assert tree.cover[leaf] == pytest.approx(h, abs=1e-4) and h >= 1.0 - 1e-4


def test_a_signal_that_is_missingness(spark):
    rows = spark.range(3000).select(
        F.col("id").alias(S.ASSET), (F.col("id") % 3 == 0).cast("int").alias(S.LABEL),
        F.when(F.col("id") % 3 != 0, F.rand(1)).alias("a"), F.when(F.col("id") % 7 > 0, F.rand(2)).alias("b"))
    split = M.holdout_split(rows, 0.2, 1)
    for spec in (M.ModelSpec(M.BOOSTED, 2, 5, early_stopping=0), M.ModelSpec(M.FOREST, 4, 20)):
        fitted = M.fit(split, ["a", "b"], spec)
        assert R.auc_value(fitted.score(split.filter("holdout"))) > 0.9


# ---------------------------------------------------------------------------------- bins

def test_bins_keep_few_values_apart_and_cut_many_by_quantile(spark):
    rows = spark.range(5000).select(F.col("id").alias(S.ASSET), (F.col("id") % 5).cast("double").alias("few"),
                                    F.col("id").cast("double").alias("many"), F.lit(None).cast("double").alias("none"),
                                    F.when(F.col("id") % 2 == 0, float("nan")).otherwise(3.0).alias("one"))
    bins = B.feature_bins(rows, ["few", "many", "none", "one"], 16)
    assert bins.edges[0] == (0.0, 1.0, 2.0, 3.0) and len(bins.edges[1]) == 15 and bins.edges[2] == () and bins.edges[3] == ()
    codes = bins.code([np.array([0.0, 1.0, 4.0, 9.0, -1.0, np.nan])] * 4)
    assert codes[0].tolist() == [1, 2, 5, 5, 1, 0] and codes[3].tolist() == [1, 1, 1, 1, 1, 0]
    counts = np.bincount(bins.code([np.arange(5000.0)] * 4)[1])
    assert counts[0] == 0 and counts[1:].min() > 300
    again = B.feature_bins(rows.repartition(7), ["few", "many", "none", "one"], 16)
    assert again == bins


def test_chunks_hold_every_row_once(spark, split, monkeypatch):
    monkeypatch.setattr(B, "CHUNK_ROWS", 100)
    bins, chunks = M.coded(split, SIGNAL, M.ModelSpec())
    got = chunks.collect()
    assert sum(c.n for c in got) == split.count() and max(c.n for c in got) <= 8192
    labels = np.concatenate([np.frombuffer(c.labels, np.uint8) for c in got])
    assert labels.sum() == split.filter("label = 1").count()
    assert all(len(c.codes) == c.n * len(SIGNAL) and len(c.keys) == 8 * c.n for c in got)


# ---------------------------------------------------------------------------------- ways of growing

def test_boosted_models_are_the_same_in_tasks_and_level_by_level(spark, small):
    specs = [M.ModelSpec(M.BOOSTED, d, n, early_stopping=p) for d, n, p in ((2, 6, 0), (4, 9, 2), (5, 3, 0))]
    together = M.fit_all(small, SIGNAL, specs)
    levels = M.fit_all(small, SIGNAL, specs, task_rows=0)
    for one, other, spec in zip(together, levels, specs):
        assert trees_of(one) == trees_of(other) and one.n_trees == other.n_trees
        assert trees_of(M.fit(small.repartition(3), SIGNAL, spec)) == trees_of(one)       # alone, and dealt otherwise


def test_large_boosted_fits_share_one_job_per_level(spark, small):
    bins, chunks = M.coded(small, SIGNAL, M.ModelSpec())
    one = {0: ("", M.ModelSpec(M.BOOSTED, 3, 2, early_stopping=0))}
    many = {i: ("", M.ModelSpec(M.BOOSTED, 3, 2, early_stopping=0, l2=1.0 + i)) for i in range(5)}
    (_, jobs_one), (_, jobs_many) = (jobs_of(spark, lambda s=s: M.fit_chunks(chunks, bins, s, task_rows=0)) for s in (one, many))
    assert jobs_many <= jobs_one + 2      # adaptive execution may split a job's stages differently


def test_forests_are_the_same_in_tasks_and_level_by_level(spark, small):
    spec = M.ModelSpec(M.FOREST, 6, 5)
    whole = M.fit(small, SIGNAL, spec)
    for rows in (0, 150, 400):      # every node by histograms; large ones by histograms, small ones in tasks
        assert trees_of(M.fit(small.repartition(5), SIGNAL, spec, task_rows=rows)) == trees_of(whole)


def test_rounds_are_added_to_a_fit(spark, small):
    spec = M.ModelSpec(M.BOOSTED, 3, 4, early_stopping=0)
    long = M.fit(small, SIGNAL, spec.with_params(n_trees=9))
    for task_rows in (BO.TASK_ROWS, 0):
        short = M.fit(small, SIGNAL, spec, task_rows)
        grown = M.more_rounds(short, small, 9, task_rows)
        assert trees_of(grown) == trees_of(long) and trees_of(grown)[:4] == trees_of(short)


def test_a_round_is_grown_once(spark, small, monkeypatch):
    """The level-by-level fit runs each round's levels once, whatever the patience keeps of them."""
    rounds = []
    real = BO._Levels._round
    monkeypatch.setattr(BO._Levels, "_round", lambda self, active: rounds.append(active) or real(self, active))
    fitted = M.fit(small, SIGNAL, M.ModelSpec(M.BOOSTED, 2, 40, early_stopping=3), task_rows=0)
    assert len(rounds) == fitted.grown_trees < 40


def test_forests_can_be_cut(spark, small):
    deep = M.fit(small, SIGNAL, M.ModelSpec(M.FOREST, 9, 7))
    for n, depth in ((7, 9), (4, 9), (7, 3), (2, 1)):
        cut = M.cut_forest(deep, n, depth)
        assert trees_of(cut) == trees_of(M.fit(small, SIGNAL, M.ModelSpec(M.FOREST, depth, n)))
    with pytest.raises(ValueError):
        M.cut_forest(deep, 8, 9)


def test_bootstrap_and_subsets_depend_on_key_and_node_alone():
    keys = np.random.default_rng(0).integers(-2 ** 62, 2 ** 62, 200_000)
    w = G.bootstrap(keys, 42, 3)
    assert abs(w.mean() - 1) < 0.01 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert (G.bootstrap(keys[::-1], 42, 3)[::-1] == w).all() and (G.bootstrap(keys, 42, 4) != w).mean() > 0.4
    nodes = np.arange(1, 4000)
    s = G.feature_subsets(nodes, 9, 3, 42, 0)
    assert s.shape == (3999, 3) and (np.diff(s, axis=1) > 0).all()
    assert np.bincount(s.reshape(-1)).min() > 1100
    assert (G.feature_subsets(nodes[50:60], 9, 3, 42, 0) == s[50:60]).all()


# ---------------------------------------------------------------------------------- models

def test_split_is_stable_and_sized(spark, split):
    n, h = split.count(), split.filter("holdout").count()
    assert n == 14743 and abs(h / n - 0.2) < 0.02
    again = split.repartition(3).filter("holdout").select("ESN")
    assert again.exceptAll(split.filter("holdout").select("ESN")).isEmpty()


@pytest.mark.parametrize("spec", [M.ModelSpec(M.FOREST, 5, 20), M.ModelSpec(M.BOOSTED, 5, 20, early_stopping=0)])
def test_signal_and_noise(spark, split, spec):
    sc = M.fit(split, SIGNAL, spec).score(split.filter("holdout"))
    assert sc.filter((F.col("score") < 0) | (F.col("score") > 1)).isEmpty()
    assert sc.count() == split.filter("holdout").count() and R.auc_value(sc) > 0.9
    noise = M.fit(split, NOISE, spec)
    assert R.auc_value(noise.score(split.filter("holdout"))) < 0.55


def test_best_round_by_patience():
    assert BO.best_round([0.5, 0.7, 0.6, 0.65, 0.9], 3) == (5, 5, False)
    assert BO.best_round([0.5, 0.7, 0.6, 0.65, 0.9], 2) == (2, 4, True)
    assert BO.best_round([0.5, 0.5, 0.5], 2) == (1, 3, True)


@pytest.mark.parametrize("task_rows", [BO.TASK_ROWS, 0])
def test_patience_keeps_the_best_round(spark, small, task_rows):
    judged = small.filter("holdout")
    full = M.fit(small, SIGNAL, M.ModelSpec(M.BOOSTED, 3, 14, early_stopping=0))
    for patience in (2, 20):
        best, last, _ = BO.best_round(full.aucs, patience)
        got = M.fit(small, SIGNAL, M.ModelSpec(M.BOOSTED, 3, 14, early_stopping=patience), task_rows)
        assert (got.n_trees, got.grown_trees) == (best, last) and got.aucs == full.aucs[:last]
        assert trees_of(got) == trees_of(full)[:last]
        assert R.auc_value(got.score(judged)) == pytest.approx(full.aucs[best - 1], abs=1e-12)
        counts = sum(r["importance"] for r in M.split_count_importance(spark, got).collect())
        assert counts == sum(sum(f >= 0 for f in t.feature) for t in trees_of(full)[:last])
        assert M.node_table(spark, got).select("tree").distinct().count() == best


def test_early_stopping_needs_both_classes(spark, small):
    one_sided = small.filter("NOT holdout OR label = 1")
    for task_rows in (BO.TASK_ROWS, 0):
        with pytest.raises(Exception, match="both classes"):
            M.fit(one_sided, SIGNAL, M.ModelSpec(M.BOOSTED, 2, 3), task_rows)


def test_node_table_thresholds_route_like_the_codes(spark, small):
    fitted = M.fit(small, SIGNAL, M.ModelSpec(M.BOOSTED, 3, 2, early_stopping=0))
    nodes = {(r["tree"], r["node"]): r for r in M.node_table(spark, fitted).collect()}
    got = {r["ESN"]: r["score"] for r in fitted.score(small).collect()}
    for row in small.limit(200).collect():
        margin = 0.0
        for t in range(2):
            n = 1
            while nodes[t, n]["feature"] is not None:
                v = row[nodes[t, n]["feature"]]
                left = nodes[t, n]["missing_left"] if v is None else v <= nodes[t, n]["threshold"]
                n = 2 * n + (not left)
            margin += nodes[t, n]["value"]
        assert got[row["ESN"]] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-12)


def test_scores_over_many_blocks(spark, small, monkeypatch):
    from faultlens.operators import ensemble as EN
    fitted = M.fit(small, SIGNAL, M.ModelSpec(M.FOREST, 4, 9))
    whole = {tuple(r) for r in fitted.score(small).collect()}
    monkeypatch.setattr(EN, "BLOCK_NODES", 50)
    monkeypatch.setattr(EN, "GROUP_CHUNKS", 1)
    parts = {r["ESN"]: r["score"] for r in fitted.score(small).collect()}
    assert len(parts) == len(whole) and all(abs(parts[k] - s) < 1e-12 for k, _, s in whole)


def test_saved_model_scores_alike(spark, small, tmp_path):
    for spec in (M.ModelSpec(M.FOREST, 4, 5), M.ModelSpec(M.BOOSTED, 3, 12, early_stopping=3)):
        fitted = M.fit(small, SIGNAL, spec)
        again = M.load_model(spark, M.save_model(fitted, str(tmp_path / spec.kind)))
        assert again.score(small).exceptAll(fitted.score(small)).isEmpty() and again.spec == spec


def test_ranking_and_top(spark, split):
    fm = M.fit(split, SIGNAL, M.ModelSpec(M.FOREST, 4, 10))
    ranking = M.rank_features(M.split_count_importance(spark, fm)).orderBy("rank").collect()
    imps = [r.importance for r in ranking]
    assert imps == sorted(imps, reverse=True)
    assert len(M.top_features(M.rank_features(M.split_count_importance(spark, fm)), 3).collect()) == 3


# ---------------------------------------------------------------------------------- tuning

@pytest.mark.parametrize("kind", [M.FOREST, M.BOOSTED])
def test_trials_equal_fits_of_their_own(spark, small, kind):
    ranges = {"max_depth": (2, 6), "n_trees": (3, 12)}
    res = TU.tune(spark, small, SIGNAL, M.ModelSpec(kind, early_stopping=4), n_trials=4, ranges=ranges)
    trials = res.trials.orderBy("trial").collect()
    judged = small.filter("holdout")
    for t in trials:
        own = M.fit(small, SIGNAL, M.ModelSpec(kind, t.max_depth, t.n_trees, early_stopping=4))
        assert own.n_trees == t.trees_used and R.auc_value(own.score(judged)) == pytest.approx(t.auc, abs=1e-12)
        if t.auc == res.best_auc and own.spec == res.best:
            assert trees_of(own) == trees_of(TU.refit_best(small, SIGNAL, res))
    assert len(trials) == 4 and res.best_auc == max(t.auc for t in trials)
    assert all(2 <= t.max_depth <= 6 and 3 <= t.n_trees <= 12 for t in trials)


def test_trials_grow_together(spark, small):
    """The number of jobs of a search does not follow the number of trials."""
    ranges = {"max_depth": (2, 4), "n_trees": (3, 6)}
    for kind in (M.FOREST, M.BOOSTED):
        run = lambda n: jobs_of(spark, lambda: TU.tune(spark, small, SIGNAL, M.ModelSpec(kind, early_stopping=2),
                                                       n_trials=n, ranges=ranges))[1]
        assert run(6) <= run(1) + 2


def test_search_ranges():
    depths = [p["max_depth"] for p in TU.sample_params(M.FOREST, 3000, 1)]
    assert min(depths) == 2 and max(depths) == 32
    trees = [p["n_trees"] for p in TU.sample_params(M.BOOSTED, 3000, 1)]
    assert min(trees) >= 50 and max(trees) <= 1000


def test_forests_of_several_tables_stay_apart(spark, small):
    """Two units in one table of chunks: each model sees its own rows only."""
    both = small.withColumn("u", F.lit("a")).unionByName(small.withColumn("u", F.lit("b")).withColumn("label", 1 - F.col("label")))
    bins, chunks = M.coded(both, SIGNAL, M.ModelSpec(), unit="u")
    spec = M.ModelSpec(M.FOREST, 4, 3)
    a, b = M.fit_chunks(chunks, bins, {0: ("a", spec), 1: ("b", spec)})
    for x, y in zip(trees_of(a), trees_of(b)):
        assert x.node == y.node and x.value == pytest.approx([1 - v for v in y.value])
    assert FO.features_per_node("sqrt", 10) == 3


def test_judged_rows_of_several_chunks_meet_the_trees_together(spark, monkeypatch):
    """Few chunks of judged rows: each group of chunks gets all trees."""
    from faultlens.operators import ensemble as EN
    from faultlens.operators import tuning as TU
    seen, whole = [], EN.sums_over_trees

    def watched(packed, *args, **kw):
        seen.append([r["n"] for r in packed.select("n").collect()])
        return whole(packed, *args, **kw)

    monkeypatch.setattr(EN, "sums_over_trees", watched)
    monkeypatch.setattr(B, "CHUNK_ROWS", 100)
    rows = spark.range(4000).selectExpr("id AS ESN", "double(id % 17) AS x", "int(id % 17 > 8 AND id % 3 > 0) AS label")
    split = M.holdout_split(rows.withColumnRenamed("label", S.LABEL).withColumnRenamed("ESN", S.ASSET), 0.2, 42).repartition(2, S.ASSET)
    bins, chunks = M.coded(split, ["x"], M.ModelSpec("forest"))
    chunks = chunks.coalesce(2)
    specs = [M.ModelSpec("forest", d, n) for d, n in ((2, 3), (4, 2))]
    aucs = TU.cut_aucs(chunks, TU.grow_for(chunks, bins, specs), specs)
    assert sum(seen[0]) == split.filter("holdout").count()
    assert len(seen[0]) <= 2 + sum(seen[0]) // 100 < chunks.count()
    assert all(0.5 < a <= 1 for a in aucs)
