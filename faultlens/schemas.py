"""Column names of the data model and read-time schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Column names of the inputs (fixed values, same as the reference's tables).
CLAIM_ID = "Claim_number"
ASSET = "ESN"
PART = "ABO_FAILURE_PART"
FAILURE_DATE = "Failure_date"
FLAG = "TNF_Flag"
OCCURRENCE = "Occurrence_time"
GROUP = "engine_model_group"
FAULTS = ("Faultlist", "Faultlist2")
LABEL = "label"

CLAIM_COLUMNS = (CLAIM_ID, ASSET, PART, FAILURE_DATE)
DISPOSITION_COLUMNS = (CLAIM_ID, FLAG)
TELEMETRY_FIXED = (ASSET, OCCURRENCE, GROUP) + FAULTS

# Suffixes of the per-feature aggregates, in output order.
AGG_SUFFIXES = ("max", "min", "avg", "std")


def feature_columns(features) -> list[str]:
    """Names of the 4 x F aggregate columns, per feature max/min/avg/std."""
    return [f"{f}_{s}" for f in features for s in AGG_SUFFIXES]


def require_columns(df: DataFrame, cols, what: str) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing column(s) {missing}; has {df.columns}")
    return df


# Accepted types per input column (FIXTURES.md): keys are strings or integers,
# dates are DATE or TIMESTAMP, packed lists and flags are strings, features are
# strings or numbers (cast leniently later).
_KEY = ("string", "int", "bigint", "smallint", "tinyint")
_TIME = ("date", "timestamp", "timestamp_ntz")
_NUMERIC_PREFIXES = ("string", "int", "bigint", "smallint", "tinyint", "float", "double", "decimal")
EXPECTED_TYPES = {
    CLAIM_ID: _KEY, ASSET: _KEY, PART: ("string",), FAILURE_DATE: _TIME, FLAG: ("string",),
    OCCURRENCE: _TIME, GROUP: ("string",), FAULTS[0]: ("string",), FAULTS[1]: ("string",),
}


def require_types(df: DataFrame, cols, what: str, features=()) -> DataFrame:
    """Fail early, with the column and its type, when an input column has a
    type the jobs cannot use."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    bad = []
    for c in cols:
        ok = EXPECTED_TYPES.get(c)
        if ok is not None and types.get(c) not in ok:
            bad.append(f"{c}: {types.get(c)} (expected {' or '.join(ok)})")
    for f in features:
        t = types.get(f, "")
        if not t.startswith(_NUMERIC_PREFIXES):
            bad.append(f"{f}: {t} (expected a string or a number)")
    if bad:
        raise TypeError(f"{what}: " + "; ".join(bad))
    return df
