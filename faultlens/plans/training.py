"""Model jobs on a feature table: screening, training, evaluation, report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens import schemas as S
from faultlens.operators import features as FT
from faultlens.operators import models as M
from faultlens.operators import roc as R
from faultlens.operators import tuning as TU
from faultlens.sources.sinks import materialize

# The model names a report is selected by.
MODEL_NAMES = {M.BOOSTED: "XGBoost", M.FOREST: "Random_Forest"}


@dataclass
class Evaluation:
    points: DataFrame
    thresholds: DataFrame
    annotations: DataFrame
    auc: float


@dataclass
class ModelReport:
    name: str
    fitted: M.FittedModel
    evaluation: Evaluation
    trials: DataFrame | None = None
    attribution: DataFrame | None = None
    attribution_summary: DataFrame | None = None
    tables: dict = field(default_factory=dict)


# Partitions of the training rows; trees do not depend on it.
TRAIN_PARTITIONS = 8


def split_table(table: DataFrame, feature_cols, ratio: float, seed: int,
                partitions: int = TRAIN_PARTITIONS, validation_ratio: float = 0.0) -> DataFrame:
    """Model matrix + holdout flag, hash-partitioned on the asset into ``partitions`` partitions."""
    cols = [S.ASSET, S.LABEL] + list(feature_cols)
    flags = ["holdout"] + (["validation"] if validation_ratio > 0 else [])
    out = M.holdout_split(FT.model_matrix(table, feature_cols), ratio, seed,
                          validation_ratio=validation_ratio).select(*cols, *flags)
    return out.repartition(partitions, S.ASSET)


def written_matrix(table: DataFrame, feature_cols, sc) -> DataFrame:
    """The model matrix, written once: the (lazy) feature table behind it is evaluated
    here and nowhere else, and later stages, the lazy attribution too, read the copy."""
    return materialize(FT.model_matrix(table, feature_cols), f"{sc.scenario_id}/matrix")


def evaluate(fitted: M.FittedModel, split: DataFrame, max_fpr: float = 0.2) -> Evaluation:
    counted = R.count_scores(fitted.score(split.filter("holdout")))
    pts = R.roc_from_counts(counted)
    auc = float(R.auc_from_counts(counted).first()["auc"])
    return Evaluation(pts, R.threshold_table(pts, max_fpr), R.roc_annotations(pts), auc)


def screen_features(spark: SparkSession, table: DataFrame, feature_cols, sc) -> tuple:
    """ranking_model: boosted trees on all features, early stopping on the
    holdout; returns (fitted, ranking, top 10)."""
    table = written_matrix(table, feature_cols, sc)
    FT.require_two_classes(table)
    split = split_table(table, feature_cols, sc.split_ratio, sc.seed, sc.training_partitions,
                        sc.validation_ratio).persist()
    try:
        spec = M.ModelSpec(M.BOOSTED, sc.max_depth, sc.max_iterations, sc.seed,
                           early_stopping=sc.early_stopping)
        fitted = M.fit(split, feature_cols, spec)
        ranking = M.rank_features(M.split_count_importance(spark, fitted))
    finally:
        split.unpersist()
    return fitted, ranking, M.top_features(ranking, 10)


def train_and_report(spark: SparkSession, table: DataFrame, feature_cols, sc, mode: str = "auto",
                     kinds=(M.BOOSTED, M.FOREST), n_trials: int = 10, ranges: dict | None = None,
                     attribution: bool = True) -> dict[str, ModelReport]:
    """Both models: tuned (``auto``, with its own patience ``M.AUTO_PATIENCE``) or with the scenario's
    parameters (``custom``), each evaluated on the holdout, with attributions."""
    from faultlens.operators import attribution as A
    table = written_matrix(table, feature_cols, sc)
    positives, negatives = FT.require_two_classes(table)
    split = split_table(table, feature_cols, sc.split_ratio, sc.seed, sc.training_partitions,
                        sc.validation_ratio).persist()
    out = {}
    try:
        for kind in kinds:
            base = M.ModelSpec(kind, sc.max_depth, sc.max_iterations, sc.seed, early_stopping=sc.early_stopping)
            trials = None
            if mode == "auto":
                res = TU.tune(spark, split, feature_cols, base.with_params(early_stopping=M.AUTO_PATIENCE), n_trials,
                              (ranges or {}).get(kind))
                fitted, trials = TU.refit_best(split, feature_cols, res), res.trials
            elif mode == "custom":
                fitted = M.fit(split, feature_cols, base)
            else:
                raise ValueError("mode is 'auto' or 'custom'")
            ev = evaluate(fitted, split)
            rep = ModelReport(MODEL_NAMES[kind], fitted, ev, trials)
            if attribution:
                train_rows = split.filter(~F.col("holdout"))
                if "validation" in split.columns:
                    train_rows = train_rows.filter(~F.col("validation"))
                rep.attribution = A.feature_attribution(spark, fitted, train_rows)
                rep.attribution_summary = A.attribution_summary(rep.attribution)
            rep.tables = {"thresholds": ev.thresholds, "roc_points": ev.points,
                          "roc_annotations": ev.annotations,
                          "metrics": spark.createDataFrame(
                              [(rep.name, fitted.n_trees, ev.auc, positives, negatives)],
                              "model string, trees int, auc double, positives long, "
                              "negatives long")}
            if trials is not None:
                rep.tables["trials"] = trials
            if rep.attribution_summary is not None:
                rep.tables["attribution_summary"] = rep.attribution_summary
            out[rep.name] = rep
    finally:
        split.unpersist()
    return out
