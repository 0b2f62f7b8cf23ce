"""Scans of claims, dispositions and telemetry.

Each reader keeps the plan lazy and selects only the columns the job uses, so
the Parquet scan's ``ReadSchema`` is pruned and later filters are pushed.
A source is a catalogue table name or a path (``format`` decides the reader).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultlens import schemas as S


def read_table(spark: SparkSession, source: str | DataFrame, fmt: str = "parquet") -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    if "/" in source or ":" in source:
        return spark.read.format(fmt).load(source)
    return spark.read.table(source)


def read_claims(spark: SparkSession, source, fmt: str = "parquet") -> DataFrame:
    """scan_claims: claim id, asset, failed part, failure date."""
    df = read_table(spark, source, fmt)
    S.require_columns(df, S.CLAIM_COLUMNS, "claims")
    S.require_types(df, S.CLAIM_COLUMNS, "claims")
    return df.select(*S.CLAIM_COLUMNS)


def read_dispositions(spark: SparkSession, source, fmt: str = "parquet") -> DataFrame:
    """scan_dispositions: claim id and flag, rows with a null in either dropped."""
    df = read_table(spark, source, fmt)
    S.require_columns(df, S.DISPOSITION_COLUMNS, "dispositions")
    S.require_types(df, S.DISPOSITION_COLUMNS, "dispositions")
    return df.select(*S.DISPOSITION_COLUMNS).dropna(how="any")


def read_telemetry(spark: SparkSession, source, features, fmt: str = "parquet") -> DataFrame:
    """scan_telemetry: the fixed columns plus the chosen features only."""
    df = read_table(spark, source, fmt)
    cols = list(S.TELEMETRY_FIXED) + [f for f in features if f not in S.TELEMETRY_FIXED]
    from faultlens.sources.layout import LAYOUT_COLUMNS
    cols += [c for c in LAYOUT_COLUMNS if c in df.columns]     # partition columns, if laid out
    S.require_columns(df, cols, "telemetry")
    S.require_types(df, S.TELEMETRY_FIXED, "telemetry",
                    features=[f for f in features if f not in S.TELEMETRY_FIXED])
    return df.select(*cols)


def scan_feature_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a stored feature table back."""
    return spark.read.format(fmt).load(path)
