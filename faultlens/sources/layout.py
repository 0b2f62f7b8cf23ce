"""Telemetry layout for partition pruning.

The platform and emission tokens of the packed group string, and the day of
the reading, become partition columns.  A cohort job on such a table reads
only the directories of the chosen platforms, emissions and days (the group
filter and the window's time bounds then act as partition filters).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens import schemas as S

PLATFORM, EMISSION, DAY = "platform", "emission", "occurrence_day"
LAYOUT_COLUMNS = (PLATFORM, EMISSION, DAY)


def with_layout_columns(telemetry: DataFrame) -> DataFrame:
    """Add platform, emission (tokens 0 and 1, null when missing) and day."""
    tokens = F.split(F.col(S.GROUP), "_")
    return (telemetry.withColumn(PLATFORM, F.get(tokens, 0))
                     .withColumn(EMISSION, F.get(tokens, 1))
                     .withColumn(DAY, F.to_date(F.col(S.OCCURRENCE))))


def write_telemetry_layout(telemetry: DataFrame, path: str) -> str:
    """Write telemetry partitioned by platform / emission / day.

    Rows of one platform, emission and day are brought together first, so there
    are few files per folder whatever the number of input tasks; the rebalance
    hint lets the engine split a hot value over several tasks and merge small ones.
    """
    (with_layout_columns(telemetry)
        .hint("rebalance", *LAYOUT_COLUMNS)
        .write.mode("overwrite").partitionBy(*LAYOUT_COLUMNS).parquet(path))
    return path


def has_layout(telemetry: DataFrame) -> bool:
    return all(c in telemetry.columns for c in LAYOUT_COLUMNS)
