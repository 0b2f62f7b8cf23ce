"""The public jobs, each one lazy DataFrame plan plus at most one small action.

build_cohort         claims -> window -> faulted assets (cohort rows)
build_feature_table  cohort rows -> one feature row per asset
feature_table_from_sources  both in one aggregation (no cohort rows kept)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from faultlens import schemas as S
from faultlens.operators import cohort as C
from faultlens.operators import features as FT
from faultlens.params import Scenario
from faultlens.sources.sinks import materialize as write_back


@dataclass
class CohortPlan:
    claims: DataFrame          # one labelled claim per kept asset
    window_rows: DataFrame     # claims x telemetry inside the window
    rows: DataFrame            # window rows of faulted assets (the cohort)
    stats: C.ClaimStats
    broadcast: bool


def plan_cohort(claims: DataFrame, dispositions: DataFrame, telemetry: DataFrame,
                sc: Scenario, broadcast_rows: int | None = C.DEFAULT_BROADCAST_ROWS,
                materialize: bool = True, materialize_window: bool | None = None) -> CohortPlan:
    """Lay out the cohort plan.

    ``materialize=True`` (for large runs) writes the claim cohort and the
    window rows once to the shared folder: the claim pipeline then runs once
    instead of three times (statistics, join, key set) and the telemetry is
    scanned once instead of twice (rows and fault key set).
    ``materialize_window=False`` keeps only the claim cohort written, for
    callers that read the window rows once.
    """
    if materialize_window is None:
        materialize_window = materialize
    cl = C.claim_cohort(claims, dispositions, sc.candidates, sc.targets)
    if materialize:
        cl = write_back(cl, f"{sc.scenario_id}/claims")
    stats = C.claim_stats(cl)
    tel = C.group_filter(telemetry, sc.platforms, sc.emissions)
    bc = stats.broadcastable(broadcast_rows)
    win = C.telemetry_window_join(cl, tel, sc.window_days, broadcast_rows, stats)
    if materialize_window:
        win = write_back(win, f"{sc.scenario_id}/window")
    rows = C.faulted_assets(win, sc.fault_codes, broadcast_keys=bc)
    return CohortPlan(cl, win, rows, stats, bc)


def build_cohort(claims, dispositions, telemetry, sc: Scenario, **kw) -> DataFrame:
    """Cohort rows: claim columns + label + telemetry columns."""
    return plan_cohort(claims, dispositions, telemetry, sc, **kw).rows


def build_feature_table(cohort_rows: DataFrame, sc: Scenario) -> DataFrame:
    return FT.feature_table(cohort_rows, sc.features)


def feature_table_from_sources(claims, dispositions, telemetry, sc: Scenario, **kw) -> DataFrame:
    """Feature table without materialising cohort rows: one telemetry scan
    feeding one partial+final aggregation."""
    kw.setdefault("materialize_window", False)    # the window rows are read once
    p = plan_cohort(claims, dispositions, telemetry, sc, **kw)
    return FT.fused_feature_table(p.window_rows, sc.features, sc.fault_codes)


def feature_names(sc: Scenario) -> list[str]:
    return S.feature_columns(sc.features)
