"""Imports every module that registers queries."""

from __future__ import annotations

from factorloom.plans import forecasting, inference, measures, outputs, panels, portfolios  # noqa: F401

FLAGSHIP = "T08_vol_target"
