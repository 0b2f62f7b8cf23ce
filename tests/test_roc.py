"""ROC / AUC against a direct numpy computation, and properties."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultlens.operators import roc as R


def roc_reference(y, s):
    """Every threshold counted on its own; a middle point goes when it continues
    the step that led to it in both counts."""
    pts = [(t, int(((s >= t) & (y == 0)).sum()), int(((s >= t) & (y == 1)).sum()))
           for t in sorted(set(s.tolist()), reverse=True)]
    kept = []
    for i, (t, fp, tp) in enumerate(pts):
        if 0 < i < len(pts) - 1:
            before, after = pts[i - 1], pts[i + 1]
            if (fp - before[1], tp - before[2]) == (after[1] - fp, after[2] - tp):
                continue
        kept.append((t, fp, tp))
    kept = [(math.inf, 0, 0)] + kept
    n, p = int((y == 0).sum()), int((y == 1).sum())
    return [k[0] for k in kept], [k[1] / n for k in kept], [k[2] / p for k in kept]


def rank_sum_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def spark_roc(spark, y, s, **kw):
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                               "asset long, label int, score double")
    pts = sorted(R.roc_points(df, **kw).collect(), key=lambda r: r.point)
    return df, pts


@pytest.mark.parametrize("n_ranges", [None, 1, 7])
def test_roc_matches_reference(spark, n_ranges):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300) * 20) / 20 + 0.3 * y
    df, pts = spark_roc(spark, y, s, n_ranges=n_ranges)
    thr, fpr, tpr = roc_reference(y, s)
    assert [p.point for p in pts] == list(range(len(thr)))
    assert np.allclose([p.Threshold for p in pts][1:], thr[1:])
    assert math.isinf(pts[0].Threshold)
    assert np.allclose([p.FPR for p in pts], fpr) and np.allclose([p.TPR for p in pts], tpr)
    auc = R.auc_value(df)
    assert abs(auc - np.trapezoid(tpr, fpr)) < 1e-12
    assert abs(auc - rank_sum_auc(y, s)) < 1e-12


def test_equal_scores_and_perfect(spark):
    y = np.array([0, 1, 0, 1, 1])
    df, pts = spark_roc(spark, y, np.full(5, 0.3))
    assert [(p.FPR, p.TPR) for p in pts] == [(0.0, 0.0), (1.0, 1.0)]
    assert R.auc_value(df) == 0.5
    df, pts = spark_roc(spark, y, y * 0.9 + 0.05)
    assert R.auc_value(df) == 1.0
    ann = R.roc_annotations(R.roc_points(df)).collect()      # n <= 5 -> every point
    assert len(ann) == len(pts)


def test_threshold_table(spark):
    y = np.array([0, 1] * 20)
    s = np.linspace(0, 1, 40)
    df, pts = spark_roc(spark, y, s)
    tt = R.threshold_table(R.roc_points(df)).collect()
    assert all(r.FPR <= 0.2 for r in tt) and len(tt) == sum(p.FPR <= 0.2 for p in pts)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=40))
def test_auc_is_rank_sum(spark, rows):
    y = np.array([r[0] for r in rows])
    s = np.array([r[1] / 6 for r in rows])
    if y.min() == y.max():
        return
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    assert abs(R.auc_value(df) - rank_sum_auc(y, s)) < 1e-12
    pts = sorted(R.roc_points(df, n_ranges=5).collect(), key=lambda r: r.point)
    f = [p.FPR for p in pts]
    t = [p.TPR for p in pts]
    assert f == sorted(f) and t == sorted(t) and (f[-1], t[-1]) == (1.0, 1.0)


def test_single_class_raises(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "label int, score double")
    with pytest.raises(ValueError):
        R.roc_points(df)


@pytest.mark.parametrize("row", [(None, 0.3), (1, None), (0, float("nan"))])
def test_rows_without_label_or_score_raise(spark, row):
    df = spark.createDataFrame([(1, 0.2), (0, 0.4), row], "label int, score double")
    with pytest.raises(ValueError, match="1 rows"):
        R.roc_points(df)
