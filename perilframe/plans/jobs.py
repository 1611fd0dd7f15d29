"""The recurring jobs, each one call: intake with checks, district rain, retraining, scoring, anomalies.

Models travel through the run log: training saves a pipeline, scoring loads the newest. Retraining deletes the
intermediate tables of the fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as V, schema
from ..operators import grids, late_rain, quality, rain, splits
from ..operators.upsert import upsert
from ..session import owned_scratch, stable
from ..sources import landed
from ..streaming import intake
from . import anomaly, models, requests, runlog

COUNTS_MODEL = "incident-counts"
LEADLAG_MODEL = "hazard-leadlag"
SEVERITY_MODEL = "incident-severity"
LOSS_MODEL = "incident-loss"
TIER_MODEL = "incident-loss-tiers"
SEARCH_MODEL = "hazard-leadlag-search"

# What the loss models predict, as logged.
LOSS_TARGET, TIER_TARGET = "log1p(estimatedLoss)", "log_loss tercile (low/medium/high)"


def daily_intake(
    spark: SparkSession, landing: str, log_path: str, progress: str, reject_path: str, as_of
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take in what landed; returns (incidents, recent feed reports, quality report)."""
    intake.start(spark, landing, log_path, progress, reject_path).awaitTermination()
    incidents = stable(intake.current(intake.read_log(spark, log_path)))
    recent = landed.trailing_window(incidents, as_of, V.DAILY_INTAKE_DAYS)
    checked = quality.report(stable(quality.incident_view(incidents)), quality.incident_rules(as_of))
    return incidents, recent, checked


def update_district_rain(
    stored: DataFrame, samples: DataFrame, grid: DataFrame, geometry: rain.Geometry, target_days: DataFrame, ingested_at
) -> DataFrame:
    """The district-day rain table with the target days rewritten from the grid.

    Samples carry id, district_id, lon, lat; the point of the smallest id stands for its district.
    """
    points = rain.centroids(samples, "district_id", "lon", "lat", "id")
    fresh = rain.daily_rain(points, grid, geometry, target_days, "district_id")
    batch = fresh.select(
        "district_id", "sample_date", *[F.col(c).cast("decimal(10,4)").alias(c) for c in V.RAIN_ALL],
        F.lit(ingested_at).cast("timestamp").alias("ingested_at"),
    )
    return upsert(stored, batch, *schema.UPSERT_RULES["district_daily_rain"])


def _log(spark: SparkSession, name: str, run: models.Run, params: dict, split: str, log_path: str, model_root: str) -> models.Run:
    """Save the model and log its settings, features, split and metrics."""
    logged = {**params, "features": ",".join(run.features), "split_method": split}
    runlog.record(spark, name, logged, run.values, run.model, log_path, model_root)
    return run


def retrain_counts(panel: DataFrame, log_path: str, model_root: str, params: dict | None = None) -> models.Run:
    params = params or V.RF_COUNTS
    with owned_scratch(panel.sparkSession):
        run, _ = models.fit_counts(panel, params)
    return _log(panel.sparkSession, COUNTS_MODEL, run, params, "last_periods", log_path, model_root)


def retrain_leadlag(training: DataFrame, log_path: str, model_root: str, params: dict | None = None) -> models.Run:
    params = params or V.GBT_LEADLAG
    with owned_scratch(training.sparkSession):
        run = models.fit_leadlag(training, params)
    return _log(training.sparkSession, LEADLAG_MODEL, run, params, "most_recent_share_of_dates", log_path, model_root)


def retrain_search(
    training: DataFrame, log_path: str, model_root: str, draws: int = V.SEARCH_DRAWS, space: dict | None = None, folds: int = V.CV_FOLDS
) -> models.Run:
    """The randomised search; the winner's settings and cross-validated score are logged with its test metrics."""
    spark = training.sparkSession
    with owned_scratch(spark):
        run = models.search_boosting(training, draws, space, folds)
    chosen = {k.removeprefix("param_"): v for k, v in run.values.items() if k.startswith("param_")}
    run.values = {k: v for k, v in run.values.items() if not k.startswith("param_")}
    return _log(spark, SEARCH_MODEL, run, {**chosen, "draws": draws, "folds": folds}, "stratified_random", log_path, model_root)


def refresh_late_rain(
    incident_rain: DataFrame, daily_rain: DataFrame, samples: DataFrame, points: DataFrame, target_days: DataFrame,
    grid: DataFrame, arrived: DataFrame, geometry: rain.Geometry, at,
) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    """(grid, rain per incident, rain per district and day, counts) after late or corrected pixels.

    Only keys whose windows hold a changed pixel are looked up again; the counts say how many.
    """
    landing = late_rain.land(grid, arrived)
    by_incident, incident_keys = late_rain.refresh_incident_rain(incident_rain, samples, landing, geometry, at)
    by_district, district_keys = late_rain.refresh_daily_rain(daily_rain, points, target_days, landing, geometry, at)
    counts = {
        "changed_pixels": landing.changed.count(), "opened_days": landing.opened.count(),
        "incident_keys": incident_keys.count(), "district_keys": district_keys.count(),
    }
    return landing.grid, by_incident, by_district, counts


def retrain_severity(
    dataset: DataFrame, log_path: str, model_root: str, params: dict | None = None, tautology_rate: float = V.TAUTOLOGY_RATE
) -> list[models.Run]:
    """The casualty models: hazard alone, all features, all features without near-certain hazards."""
    params = params or V.GBT_SEVERITY
    spark = dataset.sparkSession
    with owned_scratch(spark):
        runs = models.fit_severity(dataset, params, tautology_rate)
    return [_log(spark, f"{SEVERITY_MODEL}-{r.name}", r, params, "most_recent_rows", log_path, model_root) for r in runs]


def retrain_loss(dataset: DataFrame, log_path: str, model_root: str, params: dict | None = None) -> list[models.Run]:
    params = params or V.GBT_LOSS
    spark = dataset.sparkSession
    with owned_scratch(spark):
        runs = models.fit_loss(dataset, params)
    params = {**params, "target": LOSS_TARGET}
    return [_log(spark, f"{LOSS_MODEL}-{r.name}", r, params, "most_recent_rows", log_path, model_root) for r in runs]


def retrain_tiers(dataset: DataFrame, log_path: str, model_root: str, params: dict | None = None) -> models.Run:
    params = params or V.GBT_LOSS
    with owned_scratch(dataset.sparkSession):
        run = models.fit_tiers(dataset, params)
    params = {**params, "target": TIER_TARGET}
    return _log(dataset.sparkSession, TIER_MODEL, run, params, "most_recent_rows", log_path, model_root)


def predict_counts(asked: DataFrame, counts: DataFrame, log_path: str) -> tuple[DataFrame, DataFrame]:
    """(scored requests, rejected requests with a reason). Known names are those the model was trained on."""
    spark = asked.sparkSession
    model = runlog.load_latest(spark, COUNTS_MODEL, log_path)
    districts, hazards = (
        spark.createDataFrame([(name,) for name in names], "title string") for names in model.stages[0].labelsArray
    )
    judged = requests.judge_count_requests(asked, districts, hazards)
    features = grids.serving_features(requests.accepted(judged), counts)
    return models.score_counts(model, features), requests.rejected(judged)


def predict_hazard(
    asked: DataFrame, districts: DataFrame, daily_rain: DataFrame, log_path: str
) -> tuple[DataFrame, DataFrame]:
    """(scored requests, rejected requests with a reason)."""
    judged = requests.judge_hazard_requests(asked, districts, daily_rain)
    model = runlog.load_latest(asked.sparkSession, LEADLAG_MODEL, log_path)
    return models.score_hazard(model, requests.accepted(judged)), requests.rejected(judged)


def find_anomalies(panel: DataFrame, log_path: str) -> DataFrame:
    """Held-out periods only: rows the model trained on would look less surprising than they are."""
    _, test = splits.halves(splits.mark_last_periods(stable(panel)))
    model = runlog.load_latest(panel.sparkSession, COUNTS_MODEL, log_path)
    return anomaly.anomaly_report(model.transform(test), "prediction")
