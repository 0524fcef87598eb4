"""Every registered query, and the flagship."""

from __future__ import annotations

from panelweft.plans import (  # noqa: F401
    q_features,
    q_filters,
    q_ledger,
    q_portfolio,
    q_quality,
    q_reports,
    q_research,
    q_temporal,
)
from panelweft.plans.q_research import flagship
from panelweft.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
