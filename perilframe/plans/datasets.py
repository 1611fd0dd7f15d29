"""Feature sets for the lead-lag, casualty and loss models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions.scalar import casualty_flag, monday_zero
from ..operators import rain

LOSS_REPORT = "loss struct<peopleDeathCount:string,peopleInjuredCount:string,estimatedLoss:string>"
LEADLAG = ["row_id", "district_id", "sample_date", *V.RAIN_ALL, "label"]


def leadlag_dataset(incident_rain: DataFrame, incidents: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positives (rain at incidents) and negatives in one table, all four rain values present."""
    positives = (
        incident_rain.select("incident_id", "incident_date", *V.RAIN_ALL)
        .dropna(subset=V.RAIN_ALL)
        .join(incidents.select(F.col("id").alias("incident_id"), "district_id"), "incident_id")
        .select(
            F.col("incident_id").alias("row_id"), "district_id", F.col("incident_date").alias("sample_date"),
            *V.RAIN_ALL, F.lit(1).alias("label"),
        )
    )
    rest = negatives.dropna(subset=V.RAIN_ALL).select(
        F.col("id").cast("bigint").alias("row_id"), "district_id", "sample_date", *V.RAIN_ALL, F.lit(0).alias("label")
    )
    return positives.select(*LEADLAG).unionByName(rest.select(*LEADLAG))


def leadlag_at(samples: DataFrame, grid: DataFrame, geometry: rain.Geometry) -> DataFrame:
    """The same set straight from the grid: samples with row_id, district_id, sample_date, lon, lat and label share one lookup."""
    found = rain.at_points(samples, grid, geometry, "sample_date", "lon", "lat", gate=1)
    return found.dropna(subset=V.RAIN_ALL).select(*LEADLAG)


def leadlag_training(dataset: DataFrame) -> DataFrame:
    """Rows with a district, plus the month."""
    return dataset.dropna(subset=["district_id"]).withColumn("month", F.month("sample_date"))


def _with_rain(incidents: DataFrame, incident_rain: DataFrame, *extra) -> DataFrame:
    """Incidents that have hazard, district, time and a rain row; rain values may be NULL."""
    known = incidents.where("hazard_id is not null and district_id is not null and incident_on is not null")
    return known.select(
        F.col("id").alias("incident_id"), "incident_on", "hazard_id", "district_id",
        F.month("incident_on").alias("month"), monday_zero("incident_on").alias("day_of_week"), *extra,
    ).join(incident_rain.select("incident_id", *V.RAIN_ALL), "incident_id")


def _with_loss(incidents: DataFrame) -> DataFrame:
    """Add the report's loss object as `_r.loss`, parsed once; null where loss is not an object.

    The one-element explode keeps later filters from copying the parse.
    """
    return incidents.select("*", F.explode(F.array(F.from_json("raw_data", LOSS_REPORT))).alias("_r"))


def severity_dataset(incidents: DataFrame, incident_rain: DataFrame) -> DataFrame:
    """Casualty label from the report's loss object; other loss fields stay out (they are outcomes)."""
    label = casualty_flag(*(F.col(f"_r.loss.{c}").cast("int") for c in ("peopleDeathCount", "peopleInjuredCount")))
    return _with_rain(_with_loss(incidents), incident_rain, label.alias("casualty")).select(
        "incident_id", "incident_on", "hazard_id", "district_id", "month", "day_of_week", *V.RAIN_ALL, "casualty"
    )


def loss_dataset(incidents: DataFrame, incident_rain: DataFrame) -> DataFrame:
    """Incidents with an estimated loss, on the log scale; no outlier is capped."""
    estimate = F.col("_r.loss.estimatedLoss").cast("double")
    return (
        _with_rain(_with_loss(incidents), incident_rain, estimate.alias("estimated_loss"))
        .where("estimated_loss is not null")
        .select(
            "incident_id", "incident_on", "hazard_id", "district_id", "month", "day_of_week", *V.RAIN_ALL,
            "estimated_loss", F.log1p("estimated_loss").alias("log_loss"),
        )
    )
