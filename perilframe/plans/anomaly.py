"""Ranking of cells whose count surprised the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions.scalar import clip_round

KEYS = ["district", "hazard", "year", "month"]


def anomaly_report(scored: DataFrame, prediction: str) -> DataFrame:
    """Residual and smoothed surprise ratio against the clipped, rounded prediction."""
    return (
        scored.select(*KEYS, "incident_count", clip_round(prediction).alias("predicted"))
        .withColumn("residual", F.col("incident_count") - F.col("predicted"))
        .withColumn("surprise_ratio", (F.col("incident_count") + 1) / (F.col("predicted") + 1))
    )


def top(report: DataFrame, n: int = V.ANOMALY_ROWS) -> DataFrame:
    return report.orderBy(F.desc("surprise_ratio"), *KEYS).limit(n)


def bottom(report: DataFrame, n: int = V.ANOMALY_ROWS) -> DataFrame:
    return report.orderBy(F.asc("surprise_ratio"), *KEYS).limit(n)
