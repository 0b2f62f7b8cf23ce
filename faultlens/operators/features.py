"""Cohort rows -> one feature row per asset (max/min/avg/std per feature)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens import schemas as S
from faultlens.functions import complete_row, fault_code_match, lenient_double


class EmptyCohortError(ValueError):
    """No rows are left to aggregate or model."""


def cast_features(rows: DataFrame, features) -> DataFrame:
    """lenient_numeric: every chosen feature to double in ONE projection
    (bad text -> null); other columns pass through."""
    features = list(features)
    types = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(*[
        lenient_double(c, types[c]).alias(c) if c in features else F.col(c)
        for c in rows.columns
    ])


def drop_incomplete(rows: DataFrame, features) -> DataFrame:
    """Drop rows with null or NaN in any chosen feature."""
    return rows.na.drop(how="any", subset=list(features))


def check_not_empty(df: DataFrame, what: str = "cohort") -> DataFrame:
    """Stop early when nothing is left; ``isEmpty`` reads at most one row."""
    if df.isEmpty():
        raise EmptyCohortError(f"the {what} is empty after preprocessing")
    return df


def _agg_exprs(features, value=lambda f: F.col(f)):
    out = []
    for f in features:
        v = value(f)
        out += [F.max(v).alias(f"{f}_max"), F.min(v).alias(f"{f}_min"),
                F.avg(v).alias(f"{f}_avg"), F.stddev_samp(v).alias(f"{f}_std")]
    return out


def asset_features(rows: DataFrame, features) -> DataFrame:
    """One hash aggregate for all 4 x F outputs, partial + final.

    std is the sample deviation, null for a one-row asset.
    """
    return rows.groupBy(S.ASSET).agg(*_agg_exprs(features))


def asset_labels(rows: DataFrame) -> DataFrame:
    return rows.select(S.ASSET, S.LABEL).dropDuplicates()


def attach_label(features_df: DataFrame, labels: DataFrame) -> DataFrame:
    """feature rows LEFT JOIN distinct (asset, label)."""
    return features_df.join(labels, on=S.ASSET, how="left")


def feature_table(cohort_rows: DataFrame, features) -> DataFrame:
    """build_feature_table on materialised cohort rows: cast -> drop -> aggregate -> label.

    The label rides in the grouping key: after the one-claim rule every asset
    has one label, so this equals the reference's left join with distinct
    labels without a second shuffle.
    """
    clean = drop_incomplete(cast_features(cohort_rows, features), features)
    return clean.groupBy(S.ASSET, S.LABEL).agg(*_agg_exprs(features)) \
                .select(S.ASSET, *S.feature_columns(features), S.LABEL)


def fused_feature_table(window_rows: DataFrame, features, codes) -> DataFrame:
    """Feature table straight from window rows in one aggregation.

    Same result as faulted_assets -> cast -> drop_incomplete -> aggregate:
    per asset, a fault flag over *all* raw window rows (the match is judged
    before cleaning), and the aggregates over complete rows only (aggregate
    functions skip the nulls that ``when`` leaves).  Assets without a fault
    row, or without any complete row, are removed by the HAVING filter.
    One telemetry scan, one shuffle of partial aggregates, no join.
    """
    features = list(features)
    types = {f.name: f.dataType for f in window_rows.schema.fields}
    cast = window_rows.select(
        S.ASSET, S.LABEL,
        fault_code_match(codes, S.FAULTS).alias("_hit"),
        *[lenient_double(f, types[f]).alias(f) for f in features])
    ok = complete_row(features)
    agg = cast.groupBy(S.ASSET, S.LABEL).agg(
        F.max(F.col("_hit").cast("int")).alias("_hit"),
        F.count_if(ok).alias("_n"),
        *_agg_exprs(features, lambda f: F.when(ok, F.col(f))))
    return (agg.filter((F.col("_hit") == 1) & (F.col("_n") > 0))
               .select(S.ASSET, *S.feature_columns(features), S.LABEL))


def class_balance(table: DataFrame) -> DataFrame:
    """Number of positive and negative assets (one row)."""
    return table.agg(F.count_if(F.col(S.LABEL) == 1).alias("positives"),
                     F.count_if(F.col(S.LABEL) == 0).alias("negatives"))


def require_two_classes(table: DataFrame) -> tuple[int, int]:
    r = class_balance(table).first()
    pos, neg = int(r["positives"]), int(r["negatives"])
    if pos == 0 or neg == 0:
        raise ValueError(f"need both classes to train: {pos} positive, {neg} negative assets; "
                         "choose other components")
    return pos, neg


def model_matrix(table: DataFrame, columns, keep=(S.ASSET, S.LABEL)) -> DataFrame:
    """Chosen aggregate columns plus key and label, as model input."""
    missing = [c for c in list(columns) + list(keep) if c not in table.columns]
    if missing:
        raise ValueError(f"feature table lacks {missing}")
    return table.select(*keep, *columns)
