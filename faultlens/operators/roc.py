"""ROC points, AUC, threshold table and plot annotations as DataFrames.

Scores are first reduced to one row per distinct score (class counts), so the
work after that grows with the number of distinct scores, not rows.  Those rows
are range-partitioned by score and written once with the number of their range.
Each range is summed on its own (window partitioned by range) and adds the
totals of the ranges above it (one row per range, broadcast).  The number of
ranges is the session's shuffle partition count, which adaptive execution
lowers for small tables; any number of ranges gives the same result as one
global window.

Semantics: one point per distinct score (ties merged), thresholds
descending, a first point (+inf, 0, 0), collinear points dropped (second
difference of both running counts zero), the first and last distinct-score
points always kept.  A null label and a null or NaN score are errors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.sources.sinks import materialize


def score_counts(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(score, pos, neg, bad): class counts per distinct score (partial + final
    aggregate); ``bad`` counts rows without a label or a usable score."""
    value = F.col(score).cast("double")
    unusable = F.col(label).isNull() | value.isNull() | F.isnan(value)
    return scored.groupBy(value.alias("score")).agg(
        F.count_if(F.col(label) == 1).cast("long").alias("pos"),
        F.count_if(F.col(label) != 1).cast("long").alias("neg"),
        F.count_if(unusable).cast("long").alias("bad"))


@dataclass(frozen=True)
class Totals:
    scores: int      # distinct scores
    pos: int
    neg: int


def with_ranges(counts: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """Add ``_b``, the number of the row's score range, 0 = highest scores.
    Only meaningful when written at once: the number is the writing task's."""
    by = [F.col("score").desc()]
    ranged = counts.repartitionByRange(n_ranges, *by) if n_ranges else counts.repartitionByRange(*by)
    return ranged.withColumn("_b", F.spark_partition_id())


def prefix_sums(df: DataFrame, cols, rn: str = "_rn") -> DataFrame:
    """Inclusive running sums ``cum_<c>`` of ``cols`` by descending score, the sums of the
    ranges above ``_prev_<c>``, and a 1-based row number ``rn`` over all ranges."""
    cols = list(cols)
    w = Window.partitionBy("_b").orderBy(F.col("score").desc())
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(c).over(run).alias(f"_l_{c}") for c in cols],
                      F.row_number().over(w).alias("_l_rn"))
    # One row per range: the ordered window and the broadcast are bounded by the partition count.
    tot = df.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols],
                               F.count(F.lit(1)).alias("_t_rn"))
    w_off = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(w_off), F.lit(0)).alias(f"_prev_{c}")
                             for c in cols + ["rn"]])
    out = local.join(F.broadcast(off), on="_b", how="inner")
    return out.select(
        *df.columns,
        *[(F.col(f"_l_{c}") + F.col(f"_prev_{c}")).alias(f"cum_{c}") for c in cols],
        *[F.col(f"_prev_{c}") for c in cols],
        F.col("_prev_rn"),
        (F.col("_l_rn") + F.col("_prev_rn")).alias(rn))


@dataclass
class Counted:
    counts: DataFrame    # (score, pos, neg, bad, _b), written once
    totals: Totals


def count_scores(scored: DataFrame, score: str = "score", label: str = "label",
                 n_ranges: int | None = None) -> Counted:
    """Class counts per distinct score, written once to the shared folder so
    that totals and the running sums do not re-score the rows."""
    counts = materialize(with_ranges(score_counts(scored, score, label), n_ranges), "roc/counts")
    r = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("p"),
                   F.sum("neg").alias("q"), F.sum("bad").alias("bad")).first()
    if r["bad"]:
        raise ValueError(f"ROC: {r['bad']} rows have no label or no usable score")
    t = Totals(int(r["n"]), int(r["p"] or 0), int(r["q"] or 0))
    if t.pos == 0 or t.neg == 0:
        raise ValueError(f"ROC needs both classes: {t.pos} positive, {t.neg} negative rows")
    return Counted(counts, t)


def roc_points(scored: DataFrame, score: str = "score", label: str = "label",
               drop_intermediate: bool = True, n_ranges: int | None = None) -> DataFrame:
    """(point, Threshold, FPR, TPR); point 0 is (+inf, 0, 0)."""
    return roc_from_counts(count_scores(scored, score, label, n_ranges), drop_intermediate)


def roc_from_counts(c: Counted, drop_intermediate: bool = True) -> DataFrame:
    t = c.totals
    # The running sums feed two branches below (range heads, kept points); write them once.
    cum = materialize(prefix_sums(c.counts, ["pos", "neg"]), "roc/cumulative")
    tps, fps = F.col("cum_pos"), F.col("cum_neg")
    if drop_intermediate and t.scores > 2:
        # Neighbours: lag/lead inside the range; before a range's first row
        # the running totals of the ranges above; after its last row the
        # first row of the next range (one row per range, broadcast).
        w = Window.partitionBy("_b").orderBy(F.col("score").desc())
        heads = (cum.filter(F.col("_rn") == F.col("_prev_rn") + 1)
                    .select((F.col("_rn") - 1).alias("_hrn"), F.col("cum_pos").alias("_htp"),
                            F.col("cum_neg").alias("_hfp")))
        nb = cum.select("*",
                        F.coalesce(F.lag("cum_pos").over(w), F.col("_prev_pos")).alias("_tp0"),
                        F.coalesce(F.lag("cum_neg").over(w), F.col("_prev_neg")).alias("_fp0"),
                        F.lead("cum_pos").over(w).alias("_tp1"),
                        F.lead("cum_neg").over(w).alias("_fp1"))
        nb = nb.join(F.broadcast(heads), nb["_rn"] == heads["_hrn"], "left")
        tp1, fp1 = F.coalesce("_tp1", "_htp"), F.coalesce("_fp1", "_hfp")
        bend = ((F.col("_fp0") - 2 * fps + fp1) != 0) | ((F.col("_tp0") - 2 * tps + tp1) != 0)
        keep = (F.col("_rn") == 1) | (F.col("_rn") == t.scores) | F.coalesce(bend, F.lit(True))
        kept = nb.filter(keep).select("score", "_b", "cum_pos", "cum_neg", F.lit(1).alias("one"))
        cum = prefix_sums(kept, ["one"], rn="point").select(
            "point", "score", F.col("cum_pos"), F.col("cum_neg"))
    else:
        cum = cum.select(F.col("_rn").alias("point"), "score", "cum_pos", "cum_neg")
    pts = cum.select(F.col("point").cast("long").alias("point"),
                     F.col("score").alias("Threshold"),
                     (F.col("cum_neg") / F.lit(float(t.neg))).alias("FPR"),
                     (F.col("cum_pos") / F.lit(float(t.pos))).alias("TPR"))
    first = c.counts.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("point"), F.lit(float("inf")).alias("Threshold"),
        F.lit(0.0).alias("FPR"), F.lit(0.0).alias("TPR"))
    return first.unionByName(pts)


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label",
            n_ranges: int | None = None) -> DataFrame:
    """Area under the ROC (trapezoid rule), one row ``auc``.

    Computed as the rank-sum statistic with ties counted one half, which is
    the trapezoid area exactly; the numerator is an integer sum, so the value
    does not depend on summation order.
    """
    return auc_from_counts(count_scores(scored, score, label, n_ranges))


def auc_from_counts(c: Counted) -> DataFrame:
    t = c.totals
    num = F.sum(F.col("neg").cast("decimal(38,0)") *
                (2 * F.col("cum_pos") - F.col("pos")).cast("decimal(38,0)"))
    return prefix_sums(c.counts, ["pos"]).agg(
        (num.cast("double") / F.lit(2.0 * t.pos * t.neg)).alias("auc"))


def auc_value(scored: DataFrame, score: str = "score", label: str = "label") -> float:
    return float(roc_auc(scored, score, label).first()["auc"])


def grouped_auc(scored: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(key, rows, positives, auc) from (key, label, score), all groups in one job."""
    return grouped_auc_of_counts(scored.groupBy(key, "score").agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")), key)


def grouped_auc_of_counts(counts: DataFrame, key: str) -> DataFrame:
    """(key, rows, positives, auc) from (key, score, pos, neg), one row per key and score.

    Scores are dealt to ranges drawn from the data (:func:`with_ranges`, over all groups).  Running
    positives are summed inside a range, and the ranges above add their totals, so no task holds a whole
    group however its scores lie.  The AUC is the exact rank sum; null without both classes.
    """
    counts = materialize(with_ranges(counts.select(key, "score", "pos", "neg")), "roc/grouped")
    totals = counts.groupBy(key, "_b").agg(F.sum("pos").alias("range_pos"))
    above = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "_b", F.coalesce(F.sum("range_pos").over(above), F.lit(0)).alias("above"))
    inside = Window.partitionBy(key, "_b").orderBy(F.desc("score")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("inside", F.sum("pos").over(inside)).alias("c").join(
        totals.alias("t"), F.col(f"c.{key}").eqNullSafe(F.col(f"t.{key}")) & (F.col("c._b") == F.col("t._b"))) \
        .select(f"c.{key}", "pos", "neg", "above", "inside")
    area = F.sum((F.col("neg") * (2 * (F.col("above") + F.col("inside")) - F.col("pos"))).cast("decimal(38,0)"))
    out = ranked.groupBy(key).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("rows"), F.sum("pos").alias("positives"),
        F.sum("neg").alias("_n"), area.cast("double").alias("_a"))
    return out.select(key, "rows", "positives", F.try_divide(
        F.col("_a"), 2.0 * F.col("positives").cast("double") * F.col("_n").cast("double")).alias("auc"))


def threshold_table(points: DataFrame, max_fpr: float = 0.2) -> DataFrame:
    """ROC points with FPR <= max_fpr (the alarm thresholds worth reporting)."""
    return points.filter(F.col("FPR") <= F.lit(max_fpr))


def roc_annotations(points: DataFrame) -> DataFrame:
    """Every k-th ROC point, k = round(n / 10) half-even and at least 1, with
    the threshold rounded half-even to 2 decimals (the numbers on the plot)."""
    n = points.count()
    k = max(1, round(n / 10))  # Python round() is half-even
    return (points.filter(F.col("point") % k == 0)
                  .select("point", "FPR", "TPR", F.bround("Threshold", 2).alias("label")))

