"""Tree classifiers on the feature table.

Features become one-byte codes (:mod:`faultlens.operators.binning`); boosted trees
(:mod:`faultlens.operators.boosting`) and forests (:mod:`faultlens.operators.forest`) grow from
histograms of the codes in Spark jobs; a fitted model is a table with one row per tree.  Scores come from a
join of row chunks and tree blocks (:mod:`faultlens.operators.ensemble`), the ROC from
:mod:`faultlens.operators.roc`.

Missing values (a one-row asset has no std) need no filling: they are a bin of their own, and
every split sends them to the side where they help more.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultlens import schemas as S
from faultlens.functions import holdout_bucket, in_holdout
from faultlens.operators import binning as B
from faultlens.operators import boosting as BO
from faultlens.operators import ensemble as EN
from faultlens.operators import forest as FO
from faultlens.operators import growth as G
from faultlens.sources.sinks import read_table, write_table

BOOSTED = "boosted"
FOREST = "forest"
# Fixed value: patience of an automatic run.
AUTO_PATIENCE = 10
# Partitions among which the rows of one of several training tables are dealt.
UNIT_SPREAD = 8


@dataclass(frozen=True)
class ModelSpec:
    kind: str = BOOSTED
    max_depth: int = 5
    n_trees: int = 1000
    seed: int = 42
    early_stopping: int = 100       # boosted only: rounds without a better validation AUC, 0 = off
    step_size: float = 0.3          # boosted only
    l2: float = G.L2                # boosted only: penalty of leaf weights
    min_child_weight: float = G.MIN_CHILD_WEIGHT   # boosted only: least Hessian of a child
    feature_subset: str = "sqrt"    # forest only
    max_bins: int = 128             # codes of a feature beside the missing one

    def with_params(self, **kw) -> "ModelSpec":
        return replace(self, **kw)


def holdout_split(table: DataFrame, ratio: float = 0.2, seed: int = 42,
                  key: str = S.ASSET, validation_ratio: float = 0.0) -> DataFrame:
    """Add boolean ``holdout`` (test rows): a stable md5 bucket of the asset key.

    Not stratified, like a plain random split; unlike ``randomSplit`` it does
    not depend on partitioning or row order.  With ``validation_ratio > 0`` a
    disjoint bucket range becomes ``validation``: early stopping and trial
    choice then use it, and the test rows are only used for the final report.
    """
    out = table.withColumn("holdout", in_holdout(key, seed, ratio))
    if validation_ratio > 0:
        if ratio + validation_ratio >= 1:
            raise ValueError("test and validation shares must leave training rows")
        b = holdout_bucket(key, seed)
        lo = int(round(ratio * 10000))
        hi = lo + int(round(validation_ratio * 10000))
        out = out.withColumn("validation", (b >= F.lit(lo)) & (b < F.lit(hi)))
    return out


def tuning_rows(split_table: DataFrame) -> DataFrame:
    """Rows that judge early stopping and trials: validation if present, else test."""
    return split_table.filter(_judged(split_table))


def _judged(split_table: DataFrame):
    return F.col("validation") if "validation" in split_table.columns else F.col("holdout")


@dataclass
class FittedModel:
    spec: ModelSpec
    feature_cols: list[str]
    bins: B.Bins = field(repr=False)
    trees: DataFrame = field(repr=False)    # trees table of this model, those beyond ``n_trees`` too
    n_trees: int                    # trees that score: with early stopping the best round's
    grown_trees: int                # trees grown until the stop
    aucs: list = field(default_factory=list)    # validation AUC after each round (boosted)
    joint: DataFrame | None = None  # trees table of the whole joint fit

    @property
    def scoring_trees(self) -> DataFrame:
        return self.trees.filter(F.col("tree") < self.n_trees)

    def score(self, df: DataFrame, keep=(S.ASSET, S.LABEL)) -> DataFrame:
        """score_positive: probability of class 1, plus the kept columns."""
        keep = [c for c in keep if c in df.columns]
        packed = B.packed_rows(df, self.bins, keep)
        totals = EN.sums_over_trees(packed, self.scoring_trees, EN.add_values)
        return probabilities(totals, df.select(*keep).schema, {0: (self.spec.kind, self.n_trees)})


def probabilities(totals: DataFrame, kept: StructType, models: dict[int, tuple[str, int]]) -> DataFrame:
    """Kept columns and ``score`` from the sums over trees; ``models``: number -> (kind, trees that score).
    A single model's chunks are numbered 0."""
    def make(table, total, model):
        kind, n = models[model]
        score = 1.0 / (1.0 + np.exp(-total)) if kind == BOOSTED else total / n
        return [*table.columns, score]
    return EN.unpacked(totals, kept, "score double", make)


def renumbered(trees: DataFrame, model: int) -> DataFrame:
    """The trees of one model of a joint fit, as model 0."""
    return trees.filter(F.col("model") == model).withColumn("model", F.lit(0))


def fit(split_table: DataFrame, feature_cols, spec: ModelSpec, task_rows: int | None = None,
        key: str = S.ASSET) -> FittedModel:
    """Fit on rows with ``holdout = false`` (and ``validation = false``); early stopping of a boosted
    model judges its rounds on :func:`tuning_rows`."""
    return fit_all(split_table, feature_cols, [spec], task_rows, key)[0]


def fit_all(split_table: DataFrame, feature_cols, specs: list[ModelSpec], task_rows: int | None = None,
            key: str = S.ASSET) -> list[FittedModel]:
    """Several models of one kind on one training table, grown together."""
    bins, chunks = coded(split_table, feature_cols, specs[0], key)
    return fit_chunks(chunks, bins, {i: ("", s) for i, s in enumerate(specs)}, task_rows)


def coded(split_table: DataFrame, feature_cols, spec: ModelSpec, key: str = S.ASSET, unit: str | None = None):
    """(bins, chunks) of a split table: what every fit on it reads."""
    bins = B.feature_bins(split_table.filter(B.training_rows(split_table)), feature_cols, spec.max_bins, key)
    judged = _judged(split_table)
    return bins, B.training_chunks(split_table, bins, judged, UNIT_SPREAD, unit, key)


def fit_chunks(chunks: DataFrame, bins: B.Bins, specs: dict[int, tuple[str, ModelSpec]], task_rows: int | None = None,
               start: DataFrame | None = None) -> list[FittedModel]:
    """The models ``number -> (unit, spec)``, all of one kind, fitted together on written chunks.

    Training tables of up to ``task_rows`` rows are fitted in one task each (default: by their bytes).

    ``start``: trees table of the same (boosted) models from which the fit goes on.
    """
    kinds = {s.kind for _, s in specs.values()}
    if len(kinds) != 1:
        raise ValueError("models of a joint fit are of one kind")
    task_rows = BO.rows_per_task(len(bins.columns)) if task_rows is None else task_rows
    members = [BO.Member(m, unit, s) for m, (unit, s) in specs.items()]
    if kinds == {BOOSTED}:
        trees = BO.fit_boosted(chunks, members, bins.width, task_rows, start)
    elif kinds == {FOREST}:
        trees = FO.fit_forests(chunks, [FO.plan_of(m) for m in members], bins.width, len(bins.columns), task_rows)
    else:
        raise ValueError(f"unknown model kind {kinds}")
    rounds: dict[int, list] = {m: [] for m in specs}
    for r in trees.select("model", "tree", "auc").orderBy("model", "tree").collect():      # a row per tree
        rounds[r["model"]].append(r["auc"])
    return [fitted_of(trees, m, bins, s, rounds[m]) for m, (_, s) in specs.items()]


def fitted_of(trees: DataFrame, model: int, bins: B.Bins, spec: ModelSpec, aucs: list) -> FittedModel:
    grown = used = len(aucs)
    if not grown:
        raise ValueError("no training rows")
    if spec.kind == BOOSTED and spec.early_stopping:
        used = BO.best_round(aucs, spec.early_stopping)[0]
    return FittedModel(spec, list(bins.columns), bins, renumbered(trees, model), used, grown, aucs, trees)


def more_rounds(fitted: FittedModel, split_table: DataFrame, n_trees: int, task_rows: int | None = None,
                key: str = S.ASSET) -> FittedModel:
    """The boosted model grown on to ``n_trees`` rounds at most; the rounds it has are not fitted again."""
    if fitted.spec.kind != BOOSTED:
        raise ValueError("only boosted models grow on")
    chunks = B.training_chunks(split_table, fitted.bins, _judged(split_table), UNIT_SPREAD, None, key)
    return fit_chunks(chunks, fitted.bins, {0: ("", fitted.spec.with_params(n_trees=n_trees))}, task_rows, fitted.trees)[0]


def cut_forest(fitted: FittedModel, n_trees: int, max_depth: int) -> FittedModel:
    """The forest's first ``n_trees`` trees down to ``max_depth``: what a fit with these parameters gives."""
    if fitted.spec.kind != FOREST or n_trees > fitted.n_trees or max_depth > fitted.spec.max_depth:
        raise ValueError("only forests can be cut, and not to more than they have")
    at_end = F.lit(1 << max_depth)          # path numbers of the last depth kept begin here
    nodes = F.filter(F.arrays_zip(*G.ARRAYS), lambda x: x["node"] < 2 * at_end)

    def cut(x):
        end = x["node"] >= at_end
        out = {c: x[c] for c in G.ARRAYS}
        out |= {"feature": F.when(end, -1).otherwise(x["feature"]), "code": F.when(end, 0).otherwise(x["code"]),
                "missing_left": ~end & x["missing_left"], "gain": F.when(end, 0.0).otherwise(x["gain"])}
        return F.struct(*[v.alias(c) for c, v in out.items()])

    trees = fitted.trees.filter(F.col("tree") < n_trees).select("model", "tree", F.transform(nodes, cut).alias("x"), "auc")
    trees = trees.select("model", "tree", *[F.col(f"x.{c}").alias(c) for c in G.ARRAYS], "auc")
    return replace(fitted, spec=fitted.spec.with_params(n_trees=n_trees, max_depth=max_depth), trees=trees,
                   n_trees=n_trees, grown_trees=n_trees, aucs=[None] * n_trees)


def node_table(spark: SparkSession, fitted: FittedModel) -> DataFrame:
    """The scoring trees as a table, one row per node: tree, node (path number: root 1, children 2n and
    2n + 1), feature (null at leaves), threshold (left: value <= threshold), missing_left, gain, value, cover."""
    names = spark.createDataFrame(
        [(f, c, name, fitted.bins.threshold(f, c)) for f, name in enumerate(fitted.feature_cols)
         for c in range(1, len(fitted.bins.edges[f]) + 2)], "f int, code int, feature string, threshold double")
    nodes = fitted.scoring_trees.select("tree", F.explode(F.arrays_zip(*G.ARRAYS)).alias("x")).select(
        "tree", "x.node", F.col("x.feature").alias("f"), "x.code", "x.missing_left", "x.gain", "x.value", "x.cover")
    return nodes.join(names, ["f", "code"], "left").select(
        "tree", "node", "feature", "threshold", "missing_left", "gain", "value", "cover")


def split_count_importance(spark: SparkSession, fitted: FittedModel) -> DataFrame:
    """(feature, importance): number of splits on each feature over all trees
    (the "weight" importance); features never split on are absent.  With early stopping
    the trees grown after the best round and before the stop count too, though they do not score."""
    counts = fitted.trees.select(F.explode("feature").alias("f")).filter("f >= 0").groupBy("f").agg(
        F.count(F.lit(1)).alias("importance"))
    names = spark.createDataFrame(list(enumerate(fitted.feature_cols)), "f int, feature string")
    return counts.join(F.broadcast(names), "f").select("feature", "importance")     # one row per feature


def rank_features(importance: DataFrame) -> DataFrame:
    """Features by importance, descending; ties by name; with their rank."""
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("importance"), F.asc("feature"))
    # One row per feature: the ordered window is bounded by the feature count.
    return importance.select("feature", "importance", F.row_number().over(w).alias("rank"))


def top_features(ranking: DataFrame, k: int = 10) -> DataFrame:
    return ranking.filter(F.col("rank") <= k)


def save_model(fitted: FittedModel, path: str) -> str:
    """Store the trees and what scoring needs beside them under ``path`` (``trees``, ``meta``),
    overwriting an earlier version."""
    path = path.rstrip("/")
    spark = fitted.trees.sparkSession
    write_table(fitted.trees, f"{path}/trees")
    meta = {"spec": asdict(fitted.spec), "bins": asdict(fitted.bins), "n_trees": fitted.n_trees,
            "grown_trees": fitted.grown_trees, "aucs": fitted.aucs}
    write_table(spark.createDataFrame([(json.dumps(meta),)], "meta string"), f"{path}/meta")
    return path


def load_model(spark: SparkSession, path: str) -> FittedModel:
    path = path.rstrip("/")
    meta = json.loads(read_table(spark, f"{path}/meta").first()["meta"])
    b = meta["bins"]
    bins = B.Bins(tuple(b["columns"]), tuple(map(tuple, b["edges"])), b["max_bins"])
    return FittedModel(ModelSpec(**meta["spec"]), list(bins.columns), bins, read_table(spark, f"{path}/trees"),
                       meta["n_trees"], meta["grown_trees"], meta["aucs"])
