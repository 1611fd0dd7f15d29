"""Model runs, with the settings of `fixed_values`.

The randomised search is a job (`jobs.retrain_search`) and not registered: 30 draws by 5 folds at full rounds run for hours on one machine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..operators import grids, order_stats, profile, rain, splits
from ..plans import anomaly, datasets, jobs, models, runlog, star
from ..session import scratch_path, stable
from .base import INC, INCRAIN, KEYRAIN, RAIN, day_text, query, with_
from .tables import LEADLAG_SQL, NEGATIVES_SQL, SEVERITY_SQL, built_panel, incident_points, leadlag, losses, monthly, severity

_RUNS: dict[tuple, object] = {}


def _once(name: str, spark, sf, fit):
    """A session's model run on a folder of tables; queries that report on the same run share it."""
    key = (name, spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        _RUNS[key] = fit()
    return _RUNS[key]


def _counts(spark, sf):
    return _once("counts", spark, sf, lambda: models.fit_counts(built_panel(spark, sf)))


def _leadlag(spark, sf):
    return _once("leadlag", spark, sf, lambda: models.fit_leadlag(_training(spark, sf)))


def _training(spark, sf, **read):
    return datasets.leadlag_training(leadlag(spark, sf, **read))


@query("rf_counts")
def rf_counts(spark, sf):
    run, _ = _counts(spark, sf)
    return models.result_table(spark, [run])


@query("feature_importance")
def feature_importance(spark, sf):
    run, _ = _counts(spark, sf)
    return models.importance_table(spark, run)


@query("anomaly_report_model")
def anomaly_report_model(spark, sf):
    _, scored = _counts(spark, sf)
    return anomaly.anomaly_report(scored, "prediction")


@query("score_counts")
def score_counts(spark, sf):
    """Train, save, load the newest model, and score every observed district, hazard and period."""
    log, root = scratch_path(spark, "runs"), scratch_path(spark, "models")
    counts = stable(monthly(spark, sf))
    grid = stable(grids.full_grid(counts))
    jobs.retrain_counts(grids.panel_features(grid), log, root)
    scored, _ = jobs.predict_counts(grid.drop("incident_count"), counts, log)
    return scored


@query("anomaly_report_saved_model")
def anomaly_report_saved_model(spark, sf):
    """The last periods against the newest saved model."""
    log, root = scratch_path(spark, "runs"), scratch_path(spark, "models")
    features = stable(built_panel(spark, sf))
    jobs.retrain_counts(features, log, root)
    return jobs.find_anomalies(features, log)


@query("leadlag_model")
def leadlag_model(spark, sf):
    return models.result_table(spark, [_leadlag(spark, sf)])


@query("score_hazard")
def score_hazard(spark, sf):
    """Every district on every incident day, scored from precomputed rain; days without rain are rejected."""
    log, root = scratch_path(spark, "runs"), scratch_path(spark, "models")
    rows, grid = incident_points(spark, sf), stable(star.rain_grid(spark, sf))
    jobs.retrain_leadlag(_training(spark, sf, rows=rows, grid=grid), log, root)
    points = rain.centroids(rows, "district_id", "lon", "lat", "id")
    days = star.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("sample_date"))
    daily = stable(rain.daily_rain(points, grid, star.GEOMETRY, days, "district_id"))
    names = star.districts(spark, sf)
    dates = days.select(F.col("sample_date").cast("string").alias("date")).agg(F.collect_set("date")).scalar()
    everywhere = names.select(F.col("title").alias("district"), F.explode(dates).alias("date"))
    scored, _ = jobs.predict_hazard(everywhere, names, daily, log)
    return scored.withColumn("sample_date", F.col("sample_date").cast("string"))


def _default(spark, sf):
    return _once("default", spark, sf, lambda: models.fit_default_boosting(_training(spark, sf)))


@query("gbt_default")
def gbt_default(spark, sf):
    return models.result_table(spark, [_default(spark, sf)])


@query("default_importance")
def default_importance(spark, sf):
    return models.importance_table(spark, _default(spark, sf))


@query("lr_rain")
def lr_rain(spark, sf):
    run = models.fit_logistic("logistic_rain", stable(leadlag(spark, sf)), rain=True, district=False)
    return models.result_table(spark, [run])


@query("lr_rain_district")
def lr_rain_district(spark, sf):
    run = models.fit_logistic("logistic_rain_district", stable(leadlag(spark, sf)), rain=True, district=True)
    return models.result_table(spark, [run])


@query("lr_district")
def lr_district(spark, sf):
    run = models.fit_logistic("logistic_district", stable(leadlag(spark, sf)), rain=False, district=True)
    return models.result_table(spark, [run])


# The stand-in rate is about a third per hazard, so the certainty cut is lowered with it.
CERTAIN = 0.17


def _told(runs, dropped):
    """Runs that say how many rows were dropped for want of a rain value."""
    for run in runs:
        run.values["dropped_missing_rain"] = float(dropped)
    return runs


def _severity_runs(spark, sf):
    def fit():
        data, dropped = models.with_rain(stable(severity(spark, sf)))
        return _told(models.fit_severity(data, tautology_rate=CERTAIN), dropped)

    return _once("severity", spark, sf, fit)


def _loss_runs(spark, sf):
    def fit():
        data, dropped = models.with_rain(stable(losses(spark, sf)))
        return _told(models.fit_loss(data), dropped)

    return _once("loss", spark, sf, fit)


@query("severity_model")
def severity_model(spark, sf):
    return models.result_table(spark, _severity_runs(spark, sf))


@query("lift_table")
def lift_table(spark, sf):
    results = models.result_table(spark, _severity_runs(spark, sf))
    return runlog.lift(results, V.BASELINE_RUN, "roc_auc")


@query("severity_importance")
def severity_importance(spark, sf):
    return reduce(DataFrame.unionByName, [models.importance_table(spark, r) for r in _severity_runs(spark, sf)])


@query("leadlag_importance")
def leadlag_importance(spark, sf):
    return models.importance_table(spark, _leadlag(spark, sf))


@query("loss_model")
def loss_model(spark, sf):
    return models.result_table(spark, _loss_runs(spark, sf))


@query("loss_lift")
def loss_lift(spark, sf):
    return runlog.lift(models.result_table(spark, _loss_runs(spark, sf)), V.BASELINE_RUN, V.LOSS_METRICS[0])


@query("loss_importance")
def loss_importance(spark, sf):
    return reduce(DataFrame.unionByName, [models.importance_table(spark, r) for r in _loss_runs(spark, sf)])


def _tiers(spark, sf):
    def fit():
        data, dropped = models.with_rain(stable(losses(spark, sf)))
        return _told([models.fit_tiers(data)], dropped)

    return _once("tiers", spark, sf, fit)


@query("tier_model")
def tier_model(spark, sf):
    return models.result_table(spark, _tiers(spark, sf))


@query("tier_importance")
def tier_importance(spark, sf):
    """The mean over the three one-against-the-rest models."""
    return models.importance_table(spark, _tiers(spark, sf)[0])


@query(
    "severity_summary",
    with_(INC, RAIN, KEYRAIN, INCRAIN, SEVERITY_SQL)
    + f"""SELECT half, count(*) AS "rows", strftime(min(incident_on), '%Y-%m-%d') AS first_day, strftime(max(incident_on), '%Y-%m-%d') AS last_day,
      round(avg(casualty), 6) AS positive_rate,
      count(*) FILTER (rain_1d IS NULL OR rain_3d IS NULL OR rain_7d IS NULL OR rain_peak_7d IS NULL) AS missing_input,
      count(*) FILTER (rate > {CERTAIN}e0) AS near_certain
    FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY incident_on DESC, incident_id DESC)
        <= greatest(1, CAST(floor(count(*) OVER () * 0.2e0) AS BIGINT)) THEN 'test' ELSE 'train' END AS half,
      avg(casualty) OVER (PARTITION BY hazard_id) AS rate FROM severity) GROUP BY 1""",
)
def severity_summary(spark, sf):
    """What a casualty evaluation prints about its halves; rows with missing rain are those that training drops."""
    marked = stable(splits.mark_recent_rows(stable(severity(spark, sf)), "incident_on", "incident_id"))
    train, _ = splits.halves(marked)
    sure = profile.tautological(marked, train, "hazard_id", "casualty", CERTAIN)
    summary = profile.split_summary(marked, "incident_on", "casualty", V.RAIN_ALL, sure, "hazard_id")
    return summary.withColumns({
        "first_day": day_text("first_day"), "last_day": day_text("last_day"), "positive_rate": F.round("positive_rate", 6),
    })


@query(
    "leadlag_kept",
    with_(INC, RAIN, KEYRAIN, INCRAIN, NEGATIVES_SQL, LEADLAG_SQL)
    + """SELECT count(*) AS "rows", count(*) FILTER (district_id IS NULL) AS without_district,
      count(*) FILTER (label = 1) AS positives FROM leadlag""",
)
def leadlag_kept(spark, sf):
    """Rows of the lead-lag set, and those that training drops for want of a district."""
    return leadlag(spark, sf).agg(
        F.count("*").alias("rows"), F.count_if(F.col("district_id").isNull()).alias("without_district"),
        F.count_if(F.col("label") == 1).alias("positives"),
    )


_LOSS_HALF = """, split AS (SELECT *, ln(1 + estimated_loss) AS log_loss, CASE WHEN row_number() OVER (ORDER BY incident_on DESC, incident_id DESC)
        <= greatest(1, CAST(floor(count(*) OVER () * 0.2e0) AS BIGINT)) THEN 'test' ELSE 'train' END AS half
      FROM severity WHERE estimated_loss IS NOT NULL)"""


def _loss_marked(spark, sf):
    return stable(splits.mark_recent_rows(stable(losses(spark, sf)), "incident_on", "incident_id"))


@query(
    "loss_summary",
    with_(INC, RAIN, KEYRAIN, INCRAIN, SEVERITY_SQL) + _LOSS_HALF
    + """SELECT half, count(*) AS "rows", strftime(min(incident_on), '%Y-%m-%d') AS first_day, strftime(max(incident_on), '%Y-%m-%d') AS last_day,
      round(avg(log_loss), 6) AS mean_log_loss,
      count(*) FILTER (rain_1d IS NULL OR rain_3d IS NULL OR rain_7d IS NULL OR rain_peak_7d IS NULL) AS missing_input
    FROM split GROUP BY 1""",
)
def loss_summary(spark, sf):
    """What a loss evaluation prints about its halves."""
    summary = profile.split_summary(_loss_marked(spark, sf), "incident_on", "log_loss", V.RAIN_ALL).drop("near_certain")
    return summary.withColumnRenamed("positive_rate", "mean_log_loss").withColumns({
        "first_day": day_text("first_day"), "last_day": day_text("last_day"), "mean_log_loss": F.round("mean_log_loss", 6),
    })


@query(
    "leadlag_summary",
    with_(INC, RAIN, KEYRAIN, INCRAIN, NEGATIVES_SQL, LEADLAG_SQL)
    + """, days AS (SELECT sample_date, row_number() OVER (ORDER BY sample_date DESC) AS place, count(*) OVER () AS n
      FROM (SELECT DISTINCT sample_date FROM leadlag WHERE district_id IS NOT NULL))
    SELECT CASE WHEN place <= greatest(1, CAST(floor(n * 0.2e0) AS BIGINT)) THEN 'test' ELSE 'train' END AS half, count(*) AS "rows",
      strftime(min(sample_date), '%Y-%m-%d') AS first_day, strftime(max(sample_date), '%Y-%m-%d') AS last_day, round(avg(label), 6) AS positive_rate
    FROM leadlag JOIN days USING (sample_date) WHERE district_id IS NOT NULL GROUP BY 1""".replace("days AS", "dates AS").replace("JOIN days", "JOIN dates"),
)
def leadlag_summary(spark, sf):
    """What a lead-lag evaluation prints about its halves: rows, days and the share of incidents."""
    marked = stable(splits.mark_recent_dates(stable(_training(spark, sf)), "sample_date"))
    summary = profile.split_summary(marked, "sample_date", "label", V.RAIN_ALL).drop("missing_input", "near_certain")
    return summary.withColumns({
        "first_day": day_text("first_day"), "last_day": day_text("last_day"), "positive_rate": F.round("positive_rate", 6),
    })


@query(
    "tier_distribution",
    with_(INC, RAIN, KEYRAIN, INCRAIN, SEVERITY_SQL) + _LOSS_HALF
    + """, edge AS (SELECT quantile_cont(log_loss, 1 / 3e0) AS a, quantile_cont(log_loss, 2 / 3e0) AS b FROM split WHERE half = 'train')
    SELECT half, tier, count(*) AS "rows", round(CASE tier WHEN 0 THEN any_value(a) WHEN 1 THEN any_value(b) END, 6) AS upper_edge
    FROM (SELECT half, a, b, CASE WHEN log_loss <= a THEN 0 WHEN log_loss <= b THEN 1 ELSE 2 END AS tier FROM split, edge) GROUP BY 1, 2""",
)
def tier_distribution(spark, sf):
    """Rows of each loss tier in both halves, with the edges that the train half gives."""
    marked = _loss_marked(spark, sf)
    edges = order_stats.quantiles(splits.halves(marked)[0], "log_loss", [1 / 3, 2 / 3])
    return models.tier_table(marked, edges).withColumn("upper_edge", F.round("upper_edge", 6))
