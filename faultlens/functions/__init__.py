"""Column expressions, all built from ``pyspark.sql.functions`` (JVM side)."""

from faultlens.functions.columns import (
    NUMBER_PATTERN,
    NUMBER_PATTERN_SQL,
    complete_row,
    fault_code_match,
    group_match,
    holdout_bucket,
    in_holdout,
    lenient_double,
)

__all__ = ["NUMBER_PATTERN", "NUMBER_PATTERN_SQL", "complete_row", "fault_code_match", "group_match", "holdout_bucket",
           "in_holdout", "lenient_double"]
