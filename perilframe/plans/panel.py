"""The monthly panel, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import grids
from ..session import stable


def counts(incidents: DataFrame, districts: DataFrame, hazards: DataFrame, titles=None) -> DataFrame:
    """Monthly counts written once: every later step reads this small table, not the fact."""
    return stable(grids.monthly_counts(incidents, districts, hazards, titles))


def build_panel(
    incidents: DataFrame, districts: DataFrame, hazards: DataFrame, titles=None, historical: str = "all"
) -> DataFrame:
    return grids.panel_features(grids.full_grid(counts(incidents, districts, hazards, titles)), historical)
