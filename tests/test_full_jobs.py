"""Registered model queries run the operators' whole jobs, to their end."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

from faultlens.operators import models as M
from faultlens.operators import tuning as TU
from faultlens.plans import training
from faultlens.sources import testmap as T

from fixture_paths import SF0001


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_tuning_queries_search_the_whole_space(spark, kind):
    ranges = TU.BOOSTED_RANGES if kind == "boosted" else TU.FOREST_RANGES
    trials = E.queries()[f"tune_{kind}"](spark, SF0001).orderBy("trial").collect()
    assert [(t.max_depth, t.n_trees) for t in trials] == [(p["max_depth"], p["n_trees"]) for p in TU.sample_params(kind, 10, 42)]
    assert all(lo <= t[c] <= hi for t in trials for c, (lo, hi) in ranges.items())
    if kind == "boosted":       # an automatic run's patience is 10 rounds
        assert all(t.trees_used <= t.n_trees for t in trials) and any(t.trees_used + 10 < t.n_trees for t in trials)


def test_report_of_an_automatic_run(spark, tmp_path, monkeypatch):
    calls = []
    real = TU.tune
    monkeypatch.setattr(TU, "tune", lambda *a, **k: calls.append(a) or real(*a, **k))
    reports = training.train_and_report(spark, T.model_matrix_source(spark, SF0001), E.SIGNAL_COLS, T.scenario())
    assert [c[3].early_stopping for c in calls] == [M.AUTO_PATIENCE] * 2 and [c[4] for c in calls] == [10, 10]
    assert set(reports) == {"XGBoost", "Random_Forest"}
    for rep in reports.values():
        assert set(rep.tables) == {"thresholds", "roc_points", "roc_annotations", "metrics", "trials", "attribution_summary"}
        best = rep.tables["trials"].agg(F.max("auc")).first()[0]
        assert rep.evaluation.auc == pytest.approx(best, abs=1e-12)      # a two-way split: both judge the holdout
    summary = reports["Random_Forest"].tables["attribution_summary"]
    assert {r.feature for r in summary.collect()} == set(E.SIGNAL_COLS)


def test_custom_run_uses_the_scenario(spark):
    sc = T.scenario(max_depth=3, max_iterations=12, early_stopping=5, validation_ratio=0.1)
    reports = training.train_and_report(spark, T.model_matrix_source(spark, SF0001), E.SIGNAL_COLS, sc, mode="custom", attribution=False)
    assert reports["Random_Forest"].fitted.n_trees == 12 and reports["XGBoost"].fitted.grown_trees <= 12
    assert reports["XGBoost"].fitted.spec.early_stopping == 5
    assert all(r.evaluation.auc > 0.75 for r in reports.values())
    with pytest.raises(ValueError):
        training.train_and_report(spark, T.model_matrix_source(spark, SF0001), E.SIGNAL_COLS, sc, mode="both")
