"""faultlens: component failure diagnosis on Spark DataFrames.

Claims are labelled by failed component, joined to each asset's telemetry in
the days before the failure, kept for assets that showed chosen fault codes,
aggregated to one feature row per asset, and modelled with Spark ML.  Every
stage takes and returns DataFrames.
"""

from faultlens.params import Scenario
from faultlens.session import make_session, shared_dir

__all__ = ["Scenario", "make_session", "shared_dir"]
