"""

Every query reads the driver tables through the mapping in FIXTURES.md
(``faultlens.sources.testmap``) and runs over the whole tables.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens import schemas as S
from faultlens.functions import NUMBER_PATTERN_SQL
from faultlens.operators import attribution as A
from faultlens.operators import cohort as C
from faultlens.operators import features as FT
from faultlens.operators import models as M
from faultlens.operators import roc as R
from faultlens.operators import tuning as TU
from faultlens.plans import jobs as J
from faultlens.plans import scenarios as SC
from faultlens.sources import read_claims, read_dispositions, read_telemetry
from faultlens.sources import testmap as T
from faultlens.sources.sinks import materialize

try:    # the corpus operators and their pipeline may have been taken out of the repository
    import corpus_pipeline
    from faultlens.llm import registry as LLM
except ImportError:     # also where one of their own requirements is not installed; the rest needs neither
    LLM = corpus_pipeline = None

FLAGSHIP_DIR = os.environ.get("FAULTLENS_FLAGSHIP_DIR", "/root/testdata/sf0.001")


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def _inputs(spark: SparkSession, d: str):
    """The mapped tables through the library's own readers."""
    return (read_claims(spark, T.claims(spark, d)), read_dispositions(spark, T.dispositions(spark, d)),
            read_telemetry(spark, T.telemetry(spark, d), T.FEATURES))


def _labelled(spark, d):
    cl, dp, _ = _inputs(spark, d)
    sc = T.scenario()
    return C.labelled_claims(cl, dp, sc.candidates, sc.targets)


def _claim_cohort(spark, d):
    return C.single_claim_assets(_labelled(spark, d))


def _window(spark, d, groups=False):
    cl, dp, tel = _inputs(spark, d)
    return J.plan_cohort(cl, dp, tel, T.scenario(with_groups=groups)).window_rows


def _cohort(spark, d, groups=False):
    cl, dp, tel = _inputs(spark, d)
    return J.build_cohort(cl, dp, tel, T.scenario(with_groups=groups))


def _feature_table(spark, d, groups=False):
    return J.build_feature_table(_cohort(spark, d, groups), T.scenario())


def _fused(spark, d, groups=False):
    cl, dp, tel = _inputs(spark, d)
    return J.feature_table_from_sources(cl, dp, tel, T.scenario(with_groups=groups))


def _matrix(spark, d):
    return T.model_matrix_source(spark, d)


def _write_read(spark, df: DataFrame, name: str) -> DataFrame:
    from faultlens.session import unique_dir
    from faultlens.sources.sinks import write_table
    path = write_table(df, unique_dir(spark, name))
    return spark.read.parquet(path)


# Model stage on the per-order matrix (FIXTURES.md): signal features are
# discount max/min/std + tax; ranking uses every column.
SIGNAL_COLS = ["l_discount_max", "l_discount_min", "l_discount_std",
               "l_tax_max", "l_tax_min", "l_tax_avg", "l_tax_std"]
ALL_COLS = S.feature_columns(T.MATRIX_MEASURES)
FOREST = dict(kind="forest", max_depth=5, n_trees=1000)


def _split(spark, d, cols=SIGNAL_COLS):
    from faultlens.plans.training import split_table, written_matrix
    return split_table(written_matrix(_matrix(spark, d), cols, T.scenario()), cols, 0.2, 42)


def _fit(spark, d, cols=SIGNAL_COLS, **spec):
    return M.fit(_split(spark, d, cols), cols, M.ModelSpec(**spec))


def _tune(spark, d, kind):
    return TU.tune(spark, _split(spark, d), SIGNAL_COLS, M.ModelSpec(kind=kind, early_stopping=M.AUTO_PATIENCE))


def _screen(spark, d):
    from faultlens.plans.training import screen_features
    return screen_features(spark, _matrix(spark, d), ALL_COLS, T.scenario())


def _attribution(spark, d):
    split = _split(spark, d)
    fm = _fit(spark, d, **FOREST)
    return A.feature_attribution(spark, fm, split.filter("NOT holdout"))


def _report(spark, d, mode="auto"):
    from faultlens.plans.training import train_and_report
    return train_and_report(spark, _matrix(spark, d), SIGNAL_COLS, T.scenario(), mode=mode)


def _write_reports(spark, d):
    from faultlens.session import unique_dir
    from faultlens.sources.sinks import read_report, write_report_tables
    path = unique_dir(spark, "reports")
    for name, rep in _report(spark, d).items():
        write_report_tables(rep.tables, path, "default", name)
    return read_report(spark, path, "thresholds", "default", "XGBoost")


def _scan_feature_table(spark, d):
    from faultlens.session import unique_dir
    from faultlens.sources import scan_feature_table
    from faultlens.sources.sinks import write_table
    return scan_feature_table(spark, write_table(_fused(spark, d), unique_dir(spark, "features")))


def _line_name():
    return F.concat(F.lit("line"), F.col("l_linenumber").cast("string"))


def _importance(spark, d):
    """A fixed importance table: lines per line number."""
    return T.table(spark, d, "lineitem").groupBy(_line_name().alias("feature")).agg(
        F.count(F.lit(1)).alias("importance"))


def _phi(spark, d):
    """A fixed attribution table, with a feature whose attribution is always zero."""
    li = T.table(spark, d, "lineitem")
    phi = F.when(F.col("l_linenumber") == 1, 0.0).otherwise((F.col("l_discount") - 0.05).cast("double"))
    return li.select(F.col("l_orderkey").alias("asset"), _line_name().alias("feature"),
                     F.col("l_quantity").cast("double").alias("value"), phi.alias("phi"),
                     F.lit(0.5).alias("base_value"))


def _dated_scores(spark, d):
    li = T.table(spark, d, "lineitem")
    return li.select(F.trunc("l_shipdate", "month").alias("period"),
                     F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias(S.LABEL),
                     F.col("l_discount").cast("double").alias("score"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the feature table of the default scenario at sf0.001."""
    return _fused(spark, FLAGSHIP_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    sc = T.scenario()
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        # 2.1 scans and sinks
        "scan_claims": lambda s, d: _inputs(s, d)[0],
        "scan_dispositions": lambda s, d: _inputs(s, d)[1],
        "scan_telemetry": lambda s, d: _inputs(s, d)[2],
        "write_cohort": lambda s, d: _write_read(s, _cohort(s, d), "cohort"),
        "write_feature_table": lambda s, d: _write_read(s, _fused(s, d), "features"),
        "scan_feature_table": _scan_feature_table,
        # 2.2 projections and filters
        "candidate_filter": lambda s, d: C.candidate_filter(T.claims(s, d), sc.candidates),
        "label_claims": lambda s, d: C.label_claims(
            C.candidate_filter(T.claims(s, d), sc.candidates), sc.targets),
        "project_claims": lambda s, d: C.project_claims(C.label_claims(
            C.candidate_filter(T.claims(s, d), sc.candidates), sc.targets)),
        "exclude_no_fault": _labelled,
        "group_filter": lambda s, d: C.group_filter(T.telemetry(s, d), T.PLATFORMS, T.EMISSIONS),
        "fault_code_match": lambda s, d: _window(s, d).filter(
            C.fault_code_match(sc.fault_codes, S.FAULTS)),
        "lenient_numeric": lambda s, d: FT.cast_features(_cohort(s, d), sc.features),
        "drop_incomplete": lambda s, d: FT.drop_incomplete(
            FT.cast_features(_cohort(s, d), sc.features), sc.features),
        "model_matrix": lambda s, d: FT.model_matrix(
            _matrix(s, d), S.feature_columns(["l_discount", "l_tax"])),
        # 2.3 joins
        "join_dispositions": lambda s, d: C.join_dispositions(
            C.project_claims(C.label_claims(C.candidate_filter(T.claims(s, d), sc.candidates),
                                            sc.targets)),
            _inputs(s, d)[1]),
        "single_claim_assets": _claim_cohort,
        "telemetry_window_join": lambda s, d: _window(s, d),
        "faulted_assets": lambda s, d: _cohort(s, d),
        "attach_label": lambda s, d: FT.attach_label(
            FT.asset_features(FT.drop_incomplete(FT.cast_features(_cohort(s, d), sc.features),
                                                 sc.features), sc.features),
            FT.asset_labels(_cohort(s, d))),
        # 2.4 aggregations
        "claims_per_asset": lambda s, d: C.claims_per_asset(_labelled(s, d)),
        "asset_key_set": lambda s, d: C.asset_key_set(_window(s, d), sc.fault_codes),
        "asset_features": lambda s, d: FT.asset_features(
            FT.drop_incomplete(FT.cast_features(_cohort(s, d), sc.features), sc.features),
            sc.features),
        "asset_labels": lambda s, d: FT.asset_labels(_cohort(s, d)),
        "class_balance": lambda s, d: FT.class_balance(_fused(s, d)),
        # 2.7 split and evaluation
        "holdout_split": lambda s, d: M.holdout_split(_matrix(s, d), 0.2, 42).select(
            S.ASSET, S.LABEL, "holdout"),
        "roc_points": lambda s, d: R.roc_points(T.scored_rows(s, d)),
        "roc_auc": lambda s, d: R.roc_auc(T.scored_rows(s, d)),
        # Same results over four score ranges, checked against the same SQL.
        "roc_points_bucketed": lambda s, d: R.roc_points(T.scored_rows(s, d), n_ranges=4),
        "roc_auc_bucketed": lambda s, d: R.roc_auc(T.scored_rows(s, d), n_ranges=4),
        "threshold_table": lambda s, d: R.threshold_table(R.roc_points(T.scored_rows(s, d))),
        "roc_annotations": lambda s, d: R.roc_annotations(R.roc_points(T.scored_rows(s, d))),
        # 2.8 composite jobs
        "build_cohort": lambda s, d: _cohort(s, d),
        "build_cohort_grouped": lambda s, d: _cohort(s, d, groups=True),
        "build_feature_table": lambda s, d: _feature_table(s, d),
        "feature_table_fused": lambda s, d: _fused(s, d),
        "feature_table_grouped": lambda s, d: _fused(s, d, groups=True),
        "check_not_empty": lambda s, d: FT.check_not_empty(_fused(s, d), "feature table"),
        # 2.6 / 2.7 model stage (rows-only: no SQL engine trains trees)
        "ranking_model": lambda s, d: _screen(s, d)[1],
        "split_count_importance": lambda s, d: M.split_count_importance(
            s, _fit(s, d, ALL_COLS, kind="boosted", max_depth=5, n_trees=1000)),
        "rank_features": lambda s, d: M.rank_features(_importance(s, d)),
        "top_features": lambda s, d: M.top_features(M.rank_features(_importance(s, d)), 3),
        "screen_features": lambda s, d: _screen(s, d)[2],
        "train_boosted": lambda s, d: M.node_table(
            s, _fit(s, d, kind="boosted", max_depth=5, n_trees=1000)),
        "train_forest": lambda s, d: M.node_table(s, _fit(s, d, **FOREST)),
        "score_positive": lambda s, d: _fit(s, d, **FOREST).score(
            _split(s, d).filter("holdout")),
        "model_roc_points": lambda s, d: R.roc_points(_fit(s, d, **FOREST).score(
            _split(s, d).filter("holdout"))),
        "model_threshold_table": lambda s, d: R.threshold_table(R.roc_points(
            _fit(s, d, **FOREST).score(_split(s, d).filter("holdout")))),
        "tune_boosted": lambda s, d: _tune(s, d, "boosted").trials,
        "tune_forest": lambda s, d: _tune(s, d, "forest").trials,
        "refit_best": lambda s, d: TU.refit_best(
            _split(s, d), SIGNAL_COLS, _tune(s, d, "forest")).score(
            _split(s, d).filter("holdout")),
        "feature_attribution": _attribution,
        "attribution_summary": lambda s, d: A.attribution_summary(_phi(s, d)).drop("value_quartiles"),
        "model_attribution_summary": lambda s, d: A.attribution_summary(_attribution(s, d)),
        "period_auc": lambda s, d: SC.period_auc(_dated_scores(s, d)),
        "train_and_report": lambda s, d: _union_metrics(_report(s, d)),
        # The same with the scenario's own parameters instead of tuned ones.
        "train_and_report_custom": lambda s, d: _union_metrics(_report(s, d, mode="custom")),
        "write_report_tables": _write_reports,
        # 2.10 many scenarios, cause ranking, backward validation, history
        "multi_scenario_cohort": _multi,
        "rank_root_causes": lambda s, d: SC.rank_root_causes(
            SC.claim_history_scores(T.claims(s, d))),
        "rank_causes_by_models": _rank_by_models,
        "backward_validation": _backward,
        "metrics_history": _history,
        # Invariants of fitted models over all rows; the expected counts come from SQL.
        "score_check": _score_check,
        "attribution_check": _attribution_check,
        "backward_periods": lambda s, d: _backward(s, d).select(
            "period", "assets", "positives", F.coalesce(F.col("auc").between(0, 1), F.lit(True)).alias("auc_ok")),
        "ranked_components": lambda s, d: _rank_by_models(s, d).select(S.ASSET, "component"),
        "importance_check": _importance_check,
        "tuning_check": _tuning_check,
        "refit_check": _refit_check,
        "report_check": _report_check,
        "history_check": lambda s, d: _history(s, d).groupBy("model").agg(
            F.count(F.lit(1)).alias("runs"), F.countDistinct("model_path").alias("models"),
            F.min("positives").alias("positives"), F.min(F.col("auc").between(0, 1)).alias("auc_ok")),
    }
    if LLM:
        q |= LLM.QUERIES | {"pipeline": corpus_pipeline.run}
    return q


def _score_check(spark, d):
    """Scored holdout rows, positives among them, and scores outside 0..1 (none)."""
    scored = _fit(spark, d, **FOREST).score(_split(spark, d).filter("holdout"))
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(S.LABEL) == 1).alias("positives"),
                      F.count_if(~F.coalesce(F.col("score").between(0, 1), F.lit(False))).alias("outside"))


def _attribution_check(spark, d):
    """Per training asset: its attributed features, and whether they add up to the model's output."""
    train = _split(spark, d).filter("NOT holdout")
    fitted = _fit(spark, d, **FOREST)
    total = A.feature_attribution(spark, fitted, train).groupBy(F.col("asset").alias(S.ASSET)).agg(
        F.count(F.lit(1)).alias("features"), (F.sum("phi") + F.first("base_value")).alias("total"))
    return total.join(fitted.score(train), S.ASSET, "full").select(
        S.ASSET, "features", (F.abs(F.col("total") - F.col("score")) < 1e-9).alias("adds_up"))


def _multi(spark, d):
    cl, dp, tel = _inputs(spark, d)
    return SC.multi_scenario_feature_table(cl, dp, tel, T.scenarios(spark), T.FEATURES)


def _rank_by_models(spark, d):
    """Likely causes per asset from one forest per target component."""
    multi = _multi(spark, d).filter(F.col("scenario_id").startswith("target="))
    comps = {f"target={t}": t for t in T.CANDIDATES}
    scores, _ = SC.component_scores(spark, multi, S.feature_columns(T.FEATURES), comps,
                                    M.ModelSpec(**FOREST))
    return SC.rank_root_causes(scores)


def _backward(spark, d):
    table = T.model_matrix_source(spark, d, with_date=True)
    return SC.backward_validation(spark, table, SIGNAL_COLS, S.FAILURE_DATE, "2000-01-01",
                               M.ModelSpec(**FOREST))


def _history(spark, d):
    """An automatic and a custom run registered in one registry: models saved, metrics appended."""
    from faultlens.session import unique_dir
    registry = unique_dir(spark, "registry")
    out = None
    for mode in ("auto", "custom"):
        for name, rep in _report(spark, d, mode).items():
            _, out = SC.register_model(spark, rep.fitted, rep.tables["metrics"], registry,
                                    "default", name)
    return out


def _importance_check(spark, d):
    """Split counts over all features against the splits of the node table, and the ranking's order."""
    fitted = _fit(spark, d, **FOREST)
    counts = M.split_count_importance(spark, fitted)
    splits = M.node_table(spark, fitted).filter("feature IS NOT NULL").groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    ranked = M.rank_features(counts).join(splits, "feature", "full").withColumn(
        "ordered", F.col("importance") <= F.coalesce(F.lag("importance").over(Window.orderBy("rank")), F.col("importance")))
    return ranked.agg(F.min(F.coalesce(F.col("importance") == F.col("n"), F.lit(False))).alias("counts_ok"),
                      F.min("ordered").alias("order_ok"), F.min(F.col("feature").isin(SIGNAL_COLS)).alias("names_ok"))


def _tuning_check(spark, d):
    """Per kind and trial of a whole search: parameters in their ranges, trees used, AUC, and the best one chosen."""
    split, out = _split(spark, d), None
    for kind, ranges in (("boosted", TU.BOOSTED_RANGES), ("forest", TU.FOREST_RANGES)):
        res = TU.tune(spark, split, SIGNAL_COLS, M.ModelSpec(kind=kind, early_stopping=M.AUTO_PATIENCE))
        inside = [F.col(c).between(*r) for c, r in ranges.items()]
        best = (F.col("max_depth") == res.best.max_depth) & (F.col("n_trees") == res.best.n_trees)
        rows = res.trials.select(F.lit(kind).alias("kind"), "trial", (inside[0] & inside[1]).alias("in_ranges"),
                                 F.col("trees_used").between(1, F.col("n_trees")).alias("trees_ok"), F.col("auc").between(0, 1).alias("auc_ok"),
                                 (F.when(best, F.col("auc") == res.best_auc).otherwise(F.col("auc") <= res.best_auc)).alias("best_ok"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _refit_check(spark, d):
    """The tuned forest's holdout scores: rows, positives, scores outside 0..1, AUC as in its trial."""
    split = _split(spark, d)
    res = TU.tune(spark, split, SIGNAL_COLS, M.ModelSpec(kind="forest"))
    scored = materialize(TU.refit_best(split, SIGNAL_COLS, res).score(split.filter("holdout")), "check/scores")
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(S.LABEL) == 1).alias("positives"),
                      F.count_if(~F.coalesce(F.col("score").between(0, 1), F.lit(False))).alias("outside"),
                      F.lit(abs(R.auc_value(scored) - res.best_auc) < 1e-12).alias("same_auc"))


def _report_check(spark, d):
    """Per model of an automatic report: class balance, attributed training rows, best trial, thresholds in bounds."""
    out = None
    for name, rep in _report(spark, d).items():
        t = rep.tables
        best = t["trials"].agg(F.max("auc")).first()[0]
        rows = t["attribution_summary"].agg(F.count(F.lit(1)).alias("features"), F.min("rows").alias("rows")).first()
        low = t["thresholds"].filter("FPR > 0.2 OR TPR < 0 OR TPR > 1").isEmpty()
        one = t["metrics"].select("model", "positives", "negatives", F.lit(rows["features"]).alias("features"),
                                  F.lit(rows["rows"]).alias("attributed"), (F.abs(F.col("auc") - F.lit(best)) < 1e-12).alias("best_trial"),
                                  F.lit(low).alias("thresholds_ok"))
        out = one if out is None else out.unionByName(one)
    return out


def _union_metrics(reports) -> DataFrame:
    out = None
    for rep in reports.values():
        m = rep.tables["metrics"]
        out = m if out is None else out.unionByName(m)
    return out


# --------------------------------------------------------------------------
# DuckDB oracles (same mapping, plain SQL)
# --------------------------------------------------------------------------

_IN = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)

_CANDS = _IN(T.CANDIDATES)
_TGTS = _IN(T.TARGETS)

_BASE = f"""
claims AS (
  SELECT o_orderkey AS Claim_number, o_custkey AS ESN,
         concat_ws('|', o_orderpriority, o_orderstatus) AS ABO_FAILURE_PART,
         CAST(DATE '{T.BASE_DATE}' + CAST(o_orderkey % 30 AS INTEGER) AS DATE) AS Failure_date
  FROM orders),
disp_raw AS (
  SELECT l_orderkey AS Claim_number,
         min(CASE WHEN l_returnflag = 'R' THEN 'Y' WHEN l_returnflag = 'A' THEN 'N' END) AS TNF_Flag
  FROM lineitem GROUP BY l_orderkey, l_linestatus),
disp AS (SELECT * FROM disp_raw WHERE Claim_number IS NOT NULL AND TNF_Flag IS NOT NULL),
tel AS (
  SELECT user_id AS ESN, ts AS Occurrence_time,
         'P' || CAST(user_id % 3 AS VARCHAR) || '_E' || CAST(user_id % 2 AS VARCHAR) || '_M'
           AS engine_model_group,
         '[' || event_type || ']' AS Faultlist,
         '[' || json_extract_string(props, '$.k') || ']' AS Faultlist2,
         value, json_extract_string(props, '$.k') AS k
  FROM events),
cand AS (SELECT * FROM claims WHERE ABO_FAILURE_PART IN ({_CANDS})),
lab AS (SELECT *, CASE WHEN ABO_FAILURE_PART IN ({_TGTS}) THEN 1 ELSE 0 END AS label FROM cand),
proj AS (SELECT Claim_number, ESN, ABO_FAILURE_PART, Failure_date, label FROM lab),
joined AS (SELECT p.*, d.TNF_Flag FROM proj p LEFT JOIN disp d ON p.Claim_number = d.Claim_number),
kept AS (SELECT Claim_number, ESN, ABO_FAILURE_PART, Failure_date, label FROM joined
         WHERE TNF_Flag <> 'Y'),
counts AS (SELECT ESN, count(ESN) AS "count" FROM kept GROUP BY ESN),
single AS (SELECT * FROM kept WHERE ESN IN (SELECT ESN FROM counts WHERE "count" = 1)),
"""


def _window_sql(groups: bool) -> str:
    gf = ""
    if groups:
        conds = " OR ".join(
            f"(split_part(engine_model_group, '_', 1) = '{p}' AND "
            f"split_part(engine_model_group, '_', 2) = '{e}')"
            for p in T.PLATFORMS for e in T.EMISSIONS)
        gf = f"WHERE {conds}"
    hit = " OR ".join(f"contains(Faultlist, '[{c}]') OR contains(Faultlist2, '[{c}]')"
                      for c in T.FAULT_CODES)
    return f"""
telg AS (SELECT * FROM tel {gf}),
win AS (
  SELECT s.*, t.Occurrence_time, t.engine_model_group, t.Faultlist, t.Faultlist2, t.value, t.k
  FROM single s JOIN telg t ON s.ESN = t.ESN
  WHERE s.Failure_date >= t.Occurrence_time
    AND datediff('day', t.Occurrence_time, s.Failure_date) <= {7}),
hits AS (SELECT * FROM win WHERE {hit}),
keyset AS (SELECT DISTINCT ESN FROM hits),
cohort AS (SELECT * FROM win WHERE ESN IN (SELECT ESN FROM keyset)),
"""


def _lenient(c: str) -> str:
    t = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return (f"CASE WHEN regexp_full_match({t}, '{NUMBER_PATTERN_SQL}') "
            f"THEN TRY_CAST(replace({t}, '_', '') AS DOUBLE) END")


_FEATS = """
casted AS (SELECT Claim_number, ESN, ABO_FAILURE_PART, Failure_date, label, Occurrence_time,
                  engine_model_group, Faultlist, Faultlist2,
                  CAST(value AS DOUBLE) AS value, {lk} AS k FROM cohort),
clean AS (SELECT * FROM casted WHERE value IS NOT NULL AND NOT isnan(value)
                              AND k IS NOT NULL AND NOT isnan(k)),
agg AS (SELECT ESN,
          max(value) AS value_max, min(value) AS value_min, avg(value) AS value_avg,
          stddev_samp(value) AS value_std,
          max(k) AS k_max, min(k) AS k_min, avg(k) AS k_avg, stddev_samp(k) AS k_std
        FROM clean GROUP BY ESN),
labels AS (SELECT DISTINCT ESN, label FROM cohort),
ft AS (SELECT a.*, l.label FROM agg a LEFT JOIN labels l ON a.ESN = l.ESN)
""".replace("{lk}", _lenient("k"))


def _with(*parts: str) -> str:
    body = "".join(parts).rstrip().rstrip(",")
    return "WITH " + body.strip() + "\n"


def _matrix_sql() -> str:
    aggs = ",\n".join(
        f"max({m}) AS {m}_max, min({m}) AS {m}_min, avg({m}) AS {m}_avg, "
        f"stddev_samp({m}) AS {m}_std" for m in T.MATRIX_MEASURES)
    return f"""
mm AS (SELECT l_orderkey AS ESN, {aggs},
              CAST(avg(l_discount) > 0.05 AS INTEGER) AS label
       FROM lineitem GROUP BY l_orderkey),
"""


def _holdout(key: str, seed: int, ratio: float) -> str:
    return (f"((('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::UBIGINT % 10000)"
            f" < {int(round(ratio * 10000))})")


_ROC = """
sc AS (SELECT CAST(l_discount AS DOUBLE) AS score,
              CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem),
cnt AS (SELECT score, CAST(count_if(label = 1) AS BIGINT) AS pos,
               CAST(count_if(label <> 1) AS BIGINT) AS neg FROM sc GROUP BY score),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N, count(*) AS n_scores FROM cnt),
cum AS (SELECT score, pos, neg,
               sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
               sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps,
               row_number() OVER (ORDER BY score DESC) AS rn FROM cnt),
nb AS (SELECT *, lag(tps) OVER w AS tp0, lag(fps) OVER w AS fp0,
              lead(tps) OVER w AS tp1, lead(fps) OVER w AS fp1
       FROM cum WINDOW w AS (ORDER BY score DESC)),
kept AS (SELECT nb.* FROM nb, tot
         WHERE tot.n_scores <= 2 OR rn = 1 OR rn = tot.n_scores
            OR (coalesce(fp0, 0) - 2 * fps + fp1) <> 0 OR (coalesce(tp0, 0) - 2 * tps + tp1) <> 0),
pts AS (SELECT CAST(0 AS BIGINT) AS point, CAST('inf' AS DOUBLE) AS Threshold,
               CAST(0.0 AS DOUBLE) AS FPR, CAST(0.0 AS DOUBLE) AS TPR
        UNION ALL
        SELECT row_number() OVER (ORDER BY score DESC) AS point, score AS Threshold,
               CAST(fps AS DOUBLE) / CAST(tot.N AS DOUBLE) AS FPR,
               CAST(tps AS DOUBLE) / CAST(tot.P AS DOUBLE) AS TPR
        FROM kept, tot),
"""

_COHORT_COLS = ("Claim_number, ESN, ABO_FAILURE_PART, Failure_date, label, Occurrence_time, "
                "engine_model_group, Faultlist, Faultlist2, value, k")


def _scenarios_sql() -> str:
    def lst(xs):
        return "[" + ", ".join("'" + x + "'" for x in xs) + "]::VARCHAR[]"
    rows = [(f"target={t}", T.CANDIDATES, (t,), T.FAULT_CODES, (), ()) for t in T.CANDIDATES]
    rows.append(("grouped", T.CANDIDATES, T.TARGETS, T.FAULT_CODES, T.PLATFORMS, T.EMISSIONS))
    vals = ",\n  ".join(f"('{r[0]}', {lst(r[1])}, {lst(r[2])}, {lst(r[3])}, {lst(r[4])}, "
                        f"{lst(r[5])}, 7)" for r in rows)
    return f"""
scen(scenario_id, candidates, targets, fault_codes, platforms, emissions, window_days) AS (
  VALUES {vals}),
sparts AS (SELECT scenario_id, unnest(candidates) AS part, targets, window_days FROM scen),
slab AS (SELECT scenario_id, part,
                CASE WHEN list_contains(targets, part) THEN 1 ELSE 0 END AS label, window_days
         FROM sparts),
skept AS (SELECT c.Claim_number, c.ESN, c.ABO_FAILURE_PART, c.Failure_date
          FROM claims c JOIN disp d ON c.Claim_number = d.Claim_number
          WHERE c.ABO_FAILURE_PART IN (SELECT part FROM slab) AND d.TNF_Flag <> 'Y'),
sclaims AS (SELECT p.scenario_id, k.*, p.label, p.window_days
            FROM skept k JOIN slab p ON k.ABO_FAILURE_PART = p.part),
sones AS (SELECT scenario_id, ESN FROM sclaims GROUP BY scenario_id, ESN HAVING count(ESN) = 1),
ssingle AS (SELECT m.* FROM sclaims m
            JOIN sones o ON m.scenario_id = o.scenario_id AND m.ESN = o.ESN),
swin AS (SELECT s.scenario_id, s.ESN, s.label, t.Faultlist, t.Faultlist2, t.value, t.k
         FROM ssingle s JOIN tel t ON s.ESN = t.ESN JOIN scen sc ON sc.scenario_id = s.scenario_id
         WHERE s.Failure_date >= t.Occurrence_time
           AND datediff('day', t.Occurrence_time, s.Failure_date) <= s.window_days
           AND (len(sc.platforms) = 0 OR
                (list_contains(sc.platforms, split_part(t.engine_model_group, '_', 1)) AND
                 list_contains(sc.emissions, split_part(t.engine_model_group, '_', 2))))),
scodes AS (SELECT scenario_id, unnest(fault_codes) AS code FROM scen),
shit AS (SELECT w.*, EXISTS (SELECT 1 FROM scodes c WHERE c.scenario_id = w.scenario_id AND
                   (contains(w.Faultlist, '[' || c.code || ']') OR
                    contains(w.Faultlist2, '[' || c.code || ']'))) AS hit,
                CAST(w.value AS DOUBLE) AS v, {_lenient("w.k")} AS kk
         FROM swin w),
sok AS (SELECT *, (v IS NOT NULL AND NOT isnan(v) AND kk IS NOT NULL AND NOT isnan(kk)) AS ok
        FROM shit),
sagg AS (SELECT scenario_id, ESN, label, max(CAST(hit AS INTEGER)) AS h, count_if(ok) AS n,
           max(CASE WHEN ok THEN v END) AS value_max, min(CASE WHEN ok THEN v END) AS value_min,
           avg(CASE WHEN ok THEN v END) AS value_avg, stddev_samp(CASE WHEN ok THEN v END) AS value_std,
           max(CASE WHEN ok THEN kk END) AS k_max, min(CASE WHEN ok THEN kk END) AS k_min,
           avg(CASE WHEN ok THEN kk END) AS k_avg, stddev_samp(CASE WHEN ok THEN kk END) AS k_std
         FROM sok GROUP BY scenario_id, ESN, label),
"""


def oracle_sql() -> dict[str, str]:
    w = _window_sql(False)
    wg = _window_sql(True)
    feats_g = _FEATS
    fused = "SELECT * FROM ft WHERE ESN IN (SELECT ESN FROM keyset)"
    sql = {
        "scan_claims": _with(_BASE) + "SELECT * FROM claims",
        "scan_dispositions": _with(_BASE) + "SELECT * FROM disp",
        "scan_telemetry": _with(_BASE) + "SELECT * FROM tel",
        "write_cohort": _with(_BASE, w) + f"SELECT {_COHORT_COLS} FROM cohort",
        "write_feature_table": _with(_BASE, w, _FEATS) + "SELECT * FROM ft",
        "scan_feature_table": _with(_BASE, w, _FEATS) + "SELECT * FROM ft",
        "check_not_empty": _with(_BASE, w, _FEATS) + fused,
        "candidate_filter": _with(_BASE) + "SELECT * FROM cand",
        "label_claims": _with(_BASE) + "SELECT * FROM lab",
        "project_claims": _with(_BASE) + "SELECT * FROM proj",
        "exclude_no_fault": _with(_BASE) + "SELECT * FROM kept",
        "group_filter": _with(_BASE, _window_sql(True)) + "SELECT * FROM telg",
        "fault_code_match": _with(_BASE, w) + f"SELECT {_COHORT_COLS} FROM hits",
        "lenient_numeric": _with(_BASE, w, _FEATS) + "SELECT * FROM casted",
        "drop_incomplete": _with(_BASE, w, _FEATS) + "SELECT * FROM clean",
        "model_matrix": _with(_BASE, _matrix_sql()) +
            "SELECT ESN, label, l_discount_max, l_discount_min, l_discount_avg, l_discount_std, "
            "l_tax_max, l_tax_min, l_tax_avg, l_tax_std FROM mm",
        "join_dispositions": _with(_BASE) + "SELECT * FROM joined",
        "single_claim_assets": _with(_BASE) + "SELECT * FROM single",
        "telemetry_window_join": _with(_BASE, w) + f"SELECT {_COHORT_COLS} FROM win",
        "faulted_assets": _with(_BASE, w) + f"SELECT {_COHORT_COLS} FROM cohort",
        "attach_label": _with(_BASE, w, _FEATS) + "SELECT * FROM ft",
        "claims_per_asset": _with(_BASE) + "SELECT * FROM counts",
        "asset_key_set": _with(_BASE, w) + "SELECT * FROM keyset",
        "asset_features": _with(_BASE, w, _FEATS) + "SELECT * FROM agg",
        "asset_labels": _with(_BASE, w, _FEATS) + "SELECT * FROM labels",
        "class_balance": _with(_BASE, w, _FEATS) +
            "SELECT CAST(count_if(label = 1) AS BIGINT) AS positives, "
            "CAST(count_if(label = 0) AS BIGINT) AS negatives FROM ft",
        "holdout_split": _with(_BASE, _matrix_sql()) +
            f"SELECT ESN, label, {_holdout('ESN', 42, 0.2)} AS holdout FROM mm",
        "roc_points": _with(_ROC) + "SELECT * FROM pts",
        "roc_auc": _with(_ROC) +
            "SELECT CAST(sum(CAST(neg AS HUGEINT) * (2 * CAST(tps AS HUGEINT) - pos)) AS DOUBLE)"
            " / (2.0 * CAST(tot.P AS DOUBLE) * CAST(tot.N AS DOUBLE)) AS auc FROM cum, tot"
            " GROUP BY tot.P, tot.N",
        "threshold_table": _with(_ROC) + "SELECT * FROM pts WHERE FPR <= 0.2",
        "roc_points_bucketed": _with(_ROC) + "SELECT * FROM pts",
        "roc_annotations": _with(_ROC) +
            "SELECT point, FPR, TPR, round_even(Threshold, 2) AS label FROM pts "
            "WHERE point % greatest(CAST(round_even((SELECT count(*) FROM pts) / 10.0, 0) AS BIGINT), 1) = 0",
        "build_cohort": _with(_BASE, w) + f"SELECT {_COHORT_COLS} FROM cohort",
        "build_cohort_grouped": _with(_BASE, wg) + f"SELECT {_COHORT_COLS} FROM cohort",
        "build_feature_table": _with(_BASE, w, _FEATS) + "SELECT * FROM ft",
        "feature_table_fused": _with(_BASE, w, _FEATS) + fused,
        "feature_table_grouped": _with(_BASE, wg, feats_g) + fused,
        "multi_scenario_cohort": _with(_BASE, _scenarios_sql()) +
            "SELECT scenario_id, ESN, value_max, value_min, value_avg, value_std, "
            "k_max, k_min, k_avg, k_std, label FROM sagg WHERE h = 1 AND n > 0",
        "rank_root_causes": _with(_BASE) + """
, per AS (SELECT ESN, ABO_FAILURE_PART AS component, count(*) AS n FROM claims GROUP BY ALL),
tot AS (SELECT ESN, count(*) AS total FROM claims GROUP BY ESN),
sc AS (SELECT per.ESN, component, CAST(n AS DOUBLE) / CAST(total AS DOUBLE) AS score
       FROM per JOIN tot ON per.ESN = tot.ESN)
SELECT ESN, component, score,
       row_number() OVER (PARTITION BY ESN ORDER BY score DESC, component ASC) AS rank FROM sc""",
    }
    sql["roc_auc_bucketed"] = sql["roc_auc"]
    held = _holdout("ESN", 42, 0.2)
    sql["score_check"] = _with(_BASE, _matrix_sql()) + f"""
SELECT count(*) AS rows, count_if(label = 1) AS positives, 0 AS outside FROM mm WHERE {held}"""
    sql["attribution_check"] = _with(_BASE, _matrix_sql()) + f"""
SELECT ESN, {len(SIGNAL_COLS)} AS features, true AS adds_up FROM mm WHERE NOT {held}"""
    sql["backward_periods"] = """
WITH o AS (SELECT l_orderkey, CAST(date_trunc('month', max(l_shipdate)) AS DATE) AS period, max(l_shipdate) AS last,
  avg(l_discount) > 0.05 AS label FROM lineitem GROUP BY l_orderkey)
SELECT period, count(*) AS assets, count_if(label) AS positives, true AS auc_ok
FROM o WHERE last >= DATE '2000-01-01' GROUP BY period"""
    sql["ranked_components"] = _with(_BASE, _scenarios_sql()) + """
SELECT ESN, substr(scenario_id, 8) AS component FROM sagg WHERE scenario_id LIKE 'target=%' AND h = 1 AND n > 0"""
    sql["importance_check"] = "SELECT true AS counts_ok, true AS order_ok, true AS names_ok"
    sql["tuning_check"] = """
SELECT kind, CAST(trial AS INTEGER) AS trial, true AS in_ranges, true AS trees_ok, true AS auc_ok, true AS best_ok
FROM (VALUES ('boosted'), ('forest')) k(kind), range(10) t(trial)"""
    sql["refit_check"] = _with(_BASE, _matrix_sql()) + f"""
SELECT count(*) AS rows, count_if(label = 1) AS positives, 0 AS outside, true AS same_auc FROM mm WHERE {held}"""
    sql["report_check"] = _with(_BASE, _matrix_sql()) + f"""
SELECT model, count_if(label = 1) AS positives, count_if(label = 0) AS negatives, {len(SIGNAL_COLS)} AS features,
  count_if(NOT {held}) AS attributed, true AS best_trial, true AS thresholds_ok
FROM mm, (VALUES ('XGBoost'), ('Random_Forest')) m(model) GROUP BY model"""
    sql["history_check"] = _with(_BASE, _matrix_sql()) + """
SELECT model, 2 AS runs, 2 AS models, count_if(label = 1) AS positives, true AS auc_ok
FROM mm, (VALUES ('XGBoost'), ('Random_Forest')) m(model) GROUP BY model"""
    ranked = ("SELECT 'line' || l_linenumber AS feature, count(*) AS importance, CAST(row_number() OVER "
              "(ORDER BY count(*) DESC, 'line' || l_linenumber) AS INTEGER) AS rank FROM lineitem GROUP BY l_linenumber")
    sql["rank_features"] = ranked
    sql["top_features"] = f"SELECT * FROM ({ranked}) WHERE rank <= 3"
    sql["attribution_summary"] = """
WITH a AS (SELECT 'line' || l_linenumber AS feature, CAST(l_quantity AS DOUBLE) AS value,
  CASE WHEN l_linenumber = 1 THEN 0.0 ELSE CAST(l_discount AS DOUBLE) - 0.05 END AS phi FROM lineitem),
g AS (SELECT feature, avg(abs(phi)) AS mean_abs_phi, avg(phi) AS mean_phi, count(*) AS rows,
  CASE WHEN var_pop(value) > 0 AND var_pop(phi) > 0 THEN corr(value, phi) END AS value_phi_corr FROM a GROUP BY feature)
SELECT *, CAST(row_number() OVER (ORDER BY mean_abs_phi DESC, feature) AS INTEGER) AS rank FROM g"""
    sql["period_auc"] = """
WITH sc AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, CAST(l_discount AS DOUBLE) AS score,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem),
cnt AS (SELECT period, score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM sc GROUP BY period, score),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY period ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps FROM cnt)
SELECT period, CAST(sum(pos + neg) AS BIGINT) AS assets, CAST(sum(pos) AS BIGINT) AS positives,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(neg * (2 * tps - pos)) AS DOUBLE)
    / (2.0 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS auc FROM cum GROUP BY period"""
    if LLM:
        sql |= LLM.ORACLES
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
