"""Readers for the three inputs and writers for the hand-off tables."""

from faultlens.sources.tables import (
    read_claims,
    read_dispositions,
    read_table,
    read_telemetry,
    scan_feature_table,
)
from faultlens.sources.sinks import read_report, write_report_tables, write_table

__all__ = ["read_claims", "read_dispositions", "read_table", "read_telemetry",
           "scan_feature_table", "read_report", "write_report_tables", "write_table"]
