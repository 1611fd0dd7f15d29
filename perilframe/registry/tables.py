"""Panel, rain, datasets, lists, bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V, schema
from ..functions import scalar as S
from ..operators import grids, listing, profile, quality, rain, splits
from ..operators.upsert import update_only
from ..plans import anomaly, datasets, panel, star
from ..session import scratch_path, stable
from ..sources import tables
from .base import COUNTS, GRID, INC, INCRAIN, KEYRAIN, PANEL, RAIN, day_text, query, rounded, time_text, with_

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


def monthly(spark, sf, titles=None):
    return grids.monthly_counts(star.incidents(spark, sf), star.districts(spark, sf), star.hazards(spark, sf), titles)


def built_panel(spark, sf):
    return panel.build_panel(star.incidents(spark, sf), star.districts(spark, sf), star.hazards(spark, sf))


def rain_at_incidents(spark, sf, gate=1, grid=None, samples=None):
    grid = grid if grid is not None else stable(star.rain_grid(spark, sf))
    samples = samples if samples is not None else stable(star.samples(spark, sf))
    return rain.at_points(samples, grid, star.GEOMETRY, "incident_date", "lon", "lat", gate)


# --- panel ---------------------------------------------------------------


@query(
    "monthly_counts",
    with_(INC, COUNTS) + "SELECT * FROM counts WHERE hazard IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')",
)
def monthly_counts(spark, sf):
    return monthly(spark, sf, PRIORITIES)


@query("full_grid", with_(INC, COUNTS, GRID) + "SELECT * FROM grid")
def full_grid(spark, sf):
    return grids.full_grid(stable(monthly(spark, sf)))


_PANEL_OUT = "SELECT district, hazard, year, month, incident_count, prev_month_count, round(historical_month_avg, 6) AS historical_month_avg FROM panel"


@query("panel_features", with_(INC, COUNTS, GRID, PANEL) + _PANEL_OUT)
def panel_features(spark, sf):
    return built_panel(spark, sf).withColumn("historical_month_avg", rounded("historical_month_avg"))


@query(
    "panel_features_expanding",
    with_(INC, COUNTS, GRID) + """SELECT district, hazard, year, month, incident_count, prev_month_count,
      round(h, 6) AS historical_month_avg FROM (SELECT *,
        lag(incident_count) OVER (PARTITION BY district, hazard ORDER BY year, month) AS prev_month_count,
        avg(incident_count) OVER (PARTITION BY district, hazard, month ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h
      FROM grid) WHERE prev_month_count IS NOT NULL""",
)
def panel_features_expanding(spark, sf):
    built = panel.build_panel(
        star.incidents(spark, sf), star.districts(spark, sf), star.hazards(spark, sf), historical="expanding"
    )
    return built.withColumn("historical_month_avg", rounded("historical_month_avg"))


@query("panel_csv", with_(INC, COUNTS, GRID, PANEL) + _PANEL_OUT)
def panel_csv(spark, sf):
    """The panel written as header CSV and read back with its schema."""
    path = scratch_path(spark, "panel-csv")
    tables.write_csv(built_panel(spark, sf), path)
    return tables.read_csv(spark, path, schema.PANEL).withColumn("historical_month_avg", rounded("historical_month_avg"))


@query(
    "serve_features",
    with_(INC, COUNTS, GRID) + """SELECT g.district, g.hazard, g.year, g.month,
      CAST(coalesce(p.incident_count, 0) AS BIGINT) AS prev_month_count, round(coalesce(u.a, 0e0), 6) AS historical_month_avg
    FROM grid g
    LEFT JOIN counts p ON p.district = g.district AND p.hazard = g.hazard AND p.year * 12 + p.month = g.year * 12 + g.month - 1
    LEFT JOIN (SELECT district, hazard, month, avg(incident_count) AS a FROM counts GROUP BY 1, 2, 3) u
      ON u.district = g.district AND u.hazard = g.hazard AND u.month = g.month""",
)
def serve_features(spark, sf):
    counts = stable(monthly(spark, sf))
    requests = grids.full_grid(counts).drop("incident_count")
    return grids.serving_features(requests, counts).withColumn("historical_month_avg", rounded("historical_month_avg"))


@query(
    "seasonal_swing",
    with_(INC, COUNTS) + """SELECT hazard, CAST(max(n) AS BIGINT) AS busiest, CAST(min(n) AS BIGINT) AS quietest, round(max(n) / min(n), 6) AS swing
    FROM (SELECT hazard, month, sum(incident_count) AS n FROM counts GROUP BY 1, 2) GROUP BY 1""",
)
def seasonal_swing(spark, sf):
    return profile.seasonal_swing(monthly(spark, sf)).withColumn("swing", rounded("swing"))


@query(
    "season_flag",
    with_(INC, COUNTS) + """SELECT year, month, month BETWEEN 6 AND 9 AS monsoon, CAST(sum(incident_count) AS BIGINT) AS incidents
    FROM counts GROUP BY 1, 2, 3""",
)
def season_flag(spark, sf):
    rows = star.incidents(spark, sf).select(F.year("incident_on").alias("year"), F.month("incident_on").alias("month"))
    return rows.groupBy("year", "month").agg(F.count("*").alias("incidents")).withColumn("monsoon", S.is_monsoon("month"))


@query(
    "risk_band_count",
    with_(INC, COUNTS) + """SELECT *, CASE WHEN incident_count < 2 THEN 'Low' WHEN incident_count < 6 THEN 'Moderate' ELSE 'High' END AS risk
    FROM counts""",
)
def risk_band_count(spark, sf):
    return monthly(spark, sf).withColumn("risk", S.count_band("incident_count"))


@query(
    "risk_band_prob",
    """SELECT id, p, CASE WHEN p < 0.3e0 THEN 'Low' WHEN p < 0.6e0 THEN 'Moderate' ELSE 'High' END AS risk,
      CAST(floor(p * 100 + 0.5e0) AS INTEGER) AS percent
    FROM (SELECT o_orderkey AS id, (o_orderkey * 7919 % 1000) / 1000.0e0 AS p FROM orders)""",
)
def risk_band_prob(spark, sf):
    rows = star.scored(spark, sf).select("id", F.col("score").alias("p"))
    return rows.withColumns({"risk": S.probability_band("p"), "percent": S.percent_label("p")})


@query(
    "late_refresh",
    with_(INC, COUNTS) + "SELECT * FROM counts",
)
def late_refresh(spark, sf):
    """Counts built without the P reports, then refreshed for the periods their late arrival touches."""
    rows = star.incidents(spark, sf)
    districts, hazards = star.districts(spark, sf), star.hazards(spark, sf)
    before = stable(grids.monthly_counts(rows.where("status <> 'P'"), districts, hazards))
    late = rows.where("status = 'P'")
    periods = stable(late.select(F.year("incident_on").alias("year"), F.month("incident_on").alias("month")).distinct())
    again = grids.monthly_counts(rows.where(grids.in_periods(periods, "incident_on")), districts, hazards)
    return grids.refresh_periods(before, again, periods)


# --- anomalies -----------------------------------------------------------

_SCORED = """cut AS (SELECT min(p) AS p FROM (SELECT DISTINCT year * 12 + month AS p FROM panel ORDER BY p DESC LIMIT 3)),
report AS (
  SELECT district, hazard, year, month, incident_count, pr AS predicted, round(incident_count - pr, 6) AS residual,
         round((incident_count + 1) / (pr + 1), 6) AS surprise_ratio
  FROM (SELECT *, round_even(greatest(historical_month_avg, 0), 2) AS pr FROM panel, cut WHERE year * 12 + month >= cut.p))"""


def _report(spark, sf):
    """The historical mean as the predictor, on the last three periods."""
    _, test = splits.halves(splits.mark_last_periods(stable(built_panel(spark, sf))))
    return anomaly.anomaly_report(test, "historical_month_avg").withColumns(
        {"residual": rounded("residual"), "surprise_ratio": rounded("surprise_ratio")}
    )


@query("anomaly_report", with_(INC, COUNTS, GRID, PANEL, _SCORED) + "SELECT * FROM report")
def anomaly_report(spark, sf):
    return _report(spark, sf)


@query(
    "anomaly_top",
    with_(INC, COUNTS, GRID, PANEL, _SCORED) + "SELECT * FROM report ORDER BY surprise_ratio DESC, district, hazard, year, month LIMIT 15",
)
def anomaly_top(spark, sf):
    return anomaly.top(_report(spark, sf))


@query(
    "anomaly_bottom",
    with_(INC, COUNTS, GRID, PANEL, _SCORED) + "SELECT * FROM report ORDER BY surprise_ratio, district, hazard, year, month LIMIT 15",
)
def anomaly_bottom(spark, sf):
    return anomaly.bottom(_report(spark, sf))


# --- rain ----------------------------------------------------------------


@query(
    "rain_window_panel",
    with_(RAIN) + """SELECT district_id, strftime(date, '%Y-%m-%d') AS sample_date,
      sum(precip_mm) OVER (PARTITION BY district_id ORDER BY date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS rain_1d,
      sum(precip_mm) OVER (PARTITION BY district_id ORDER BY date RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS rain_3d,
      sum(precip_mm) OVER (PARTITION BY district_id ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS rain_7d,
      max(precip_mm) OVER (PARTITION BY district_id ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS rain_peak_7d
    FROM rain""",
)
def rain_window_panel(spark, sf):
    w = rain.panel_windows(star.daily_panel(spark, sf), ["district_id"], "date", "precip_mm")
    return w.select("district_id", day_text("date").alias("sample_date"), *V.RAIN_ALL)


@query(
    "rain_window_points",
    with_(INC, RAIN, KEYRAIN, INCRAIN) + """SELECT incident_id, strftime(incident_date, '%Y-%m-%d') AS incident_date,
      rain_1d, rain_3d, rain_7d, rain_peak_7d FROM incrain""",
)
def rain_window_points(spark, sf):
    return rain_at_incidents(spark, sf).select(
        "incident_id", day_text("incident_date").alias("incident_date"), *V.RAIN_ALL
    )


@query(
    "rain_coverage",
    with_(INC, RAIN) + """SELECT strftime(d, '%Y-%m-%d') AS incident_date,
      count(i) FILTER (i >= d - 1) AS images_1d, count(i) FILTER (i >= d - 3) AS images_3d, count(i) AS images_7d
    FROM (SELECT DISTINCT CAST(incident_on AS DATE) AS d FROM inc)
    LEFT JOIN (SELECT DISTINCT date AS i FROM rain) ON i >= d - 7 AND i < d GROUP BY 1""",
)
def rain_coverage(spark, sf):
    days = star.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("incident_date"))
    seen = star.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return rain.coverage(days, seen, "incident_date").withColumn("incident_date", day_text("incident_date"))


_CENTROIDS = """cen AS (SELECT district_id, min_by(lon, id) AS lon, min_by(lat, id) AS lat FROM inc GROUP BY 1)"""


@query("district_centroids", with_(INC, _CENTROIDS) + "SELECT * FROM cen")
def district_centroids(spark, sf):
    return rain.centroids(star.incidents(spark, sf), "district_id", "lon", "lat", "id")


@query(
    "daily_rain",
    with_(INC, RAIN) + """SELECT * FROM (SELECT c.district_id, strftime(d, '%Y-%m-%d') AS sample_date,
      sum(CASE WHEN r.date >= d - 1 THEN precip_mm END) AS rain_1d, sum(CASE WHEN r.date >= d - 3 THEN precip_mm END) AS rain_3d,
      sum(precip_mm) AS rain_7d, max(precip_mm) AS rain_peak_7d
    FROM (SELECT DISTINCT district_id FROM inc) c CROSS JOIN (SELECT DISTINCT CAST(incident_on AS DATE) AS d FROM inc)
    JOIN rain r ON r.district_id = c.district_id AND r.date >= d - 7 AND r.date < d GROUP BY 1, 2)
    WHERE rain_1d IS NOT NULL AND rain_3d IS NOT NULL AND rain_7d IS NOT NULL AND rain_peak_7d IS NOT NULL""",
)
def daily_rain(spark, sf):
    """Every district's centroid on every day that has an incident somewhere."""
    rows = star.incidents(spark, sf)
    points = rain.centroids(rows, "district_id", "lon", "lat", "id")
    days = star.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("sample_date"))
    done = rain.daily_rain(points, stable(star.rain_grid(spark, sf)), star.GEOMETRY, days, "district_id")
    return done.withColumn("sample_date", day_text("sample_date"))


# --- datasets ------------------------------------------------------------

LEADLAG_SQL = """leadlag AS (
  SELECT incident_id AS row_id, district_id, incident_date AS sample_date, rain_1d, rain_3d, rain_7d, rain_peak_7d, 1 AS label
  FROM incrain WHERE rain_1d IS NOT NULL AND rain_3d IS NOT NULL AND rain_7d IS NOT NULL AND rain_peak_7d IS NOT NULL
  UNION ALL
  SELECT * FROM (SELECT n.id, n.district_id, n.d, sum(CASE WHEN r.date >= n.d - 1 THEN precip_mm END) AS a,
      sum(CASE WHEN r.date >= n.d - 3 THEN precip_mm END) AS b, sum(precip_mm) AS c, max(precip_mm) AS e, 0
    FROM neg n JOIN rain r ON r.district_id = n.district_id AND r.date >= n.d - 7 AND r.date < n.d
    WHERE n.d - 1 IN (SELECT date FROM rain) GROUP BY 1, 2, 3) WHERE a IS NOT NULL)"""

NEGATIVES_SQL = """pos AS (SELECT DISTINCT district_id AS k, CAST(incident_on AS DATE) AS pd FROM inc),
days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM (
  SELECT min(incident_on) AS a, max(incident_on) AS b FROM inc)),
free AS (SELECT district_id, d, CAST(district_id AS BIGINT) * 1000000 + date_diff('day', DATE '1970-01-01', d) AS number
  FROM (SELECT DISTINCT district_id FROM inc) CROSS JOIN days
  LEFT JOIN pos ON k = district_id AND pd = d WHERE k IS NULL),
neg AS (SELECT number AS id, district_id, d FROM (SELECT *, row_number() OVER
    (ORDER BY ((number % 2147483647) * 2654435761 + 42) % 4294967296, number) AS rn FROM free)
  WHERE rn <= 2 * (SELECT count(*) FROM inc))"""


def negatives(spark, sf, rows=None):
    """Drawn non-event days with an id, at the district's point."""
    rows = incident_points(spark, sf) if rows is None else rows
    points = rain.centroids(rows, "district_id", "lon", "lat", "id")
    positives = rows.select("district_id", F.to_date("incident_on").alias("sample_date"))
    # On the large tables events are so dense that too few (district, day) pairs are free; the ratio says how few.
    drawn = splits.negative_samples(positives, points, "district_id", "sample_date", allow_fewer=True)
    number = F.col("district_id").cast("bigint") * 1_000_000 + F.unix_date("sample_date")
    return drawn.select(number.alias("id"), "district_id", "sample_date", "lon", "lat", "achieved_ratio")


def negatives_with_rain(spark, sf, grid=None):
    """Rain written into the drawn rows; rows over uncovered days keep NULLs."""
    grid = grid if grid is not None else stable(star.rain_grid(spark, sf))
    drawn = stable(negatives(spark, sf).drop("achieved_ratio"))
    empty = drawn.withColumns({c: F.lit(None).cast("double") for c in V.RAIN_ALL})
    found = rain.at_points(drawn, grid, star.GEOMETRY, "sample_date", "lon", "lat", gate=1)
    return update_only(empty, found, ["id"], V.RAIN_ALL)


def incident_points(spark, sf):
    return stable(star.incidents(spark, sf).select("id", "district_id", "incident_on", "lon", "lat"))


def leadlag(spark, sf, rows=None, grid=None):
    """Incidents and drawn days are looked up in the grid together. Callers that read the incident points or the grid again pass them."""
    rows = rows if rows is not None else incident_points(spark, sf)
    grid = grid if grid is not None else stable(star.rain_grid(spark, sf))
    drawn = negatives(spark, sf, rows).select("id", "district_id", "sample_date", "lon", "lat", F.lit(0).alias("label"))
    events = rows.select("id", "district_id", F.to_date("incident_on").alias("sample_date"), "lon", "lat", F.lit(1).alias("label"))
    samples = events.unionByName(stable(drawn)).withColumnRenamed("id", "row_id")  # both are written
    return datasets.leadlag_at(samples, grid, star.GEOMETRY)


@query(
    "negative_samples",
    with_(INC, NEGATIVES_SQL) + """SELECT id, district_id, strftime(d, '%Y-%m-%d') AS sample_date,
      round((SELECT count(*) FROM neg) / CAST((SELECT count(*) FROM inc) AS DOUBLE), 6) AS achieved_ratio FROM neg""",
)
def negative_samples(spark, sf):
    return negatives(spark, sf).select(
        "id", "district_id", day_text("sample_date").alias("sample_date"), F.round("achieved_ratio", 6).alias("achieved_ratio")
    )


@query(
    "rain_negatives",
    with_(INC, RAIN, NEGATIVES_SQL) + """SELECT n.id, CASE WHEN ok THEN a END AS rain_1d, CASE WHEN ok THEN b END AS rain_3d,
      CASE WHEN ok THEN c END AS rain_7d, CASE WHEN ok THEN e END AS rain_peak_7d
    FROM (SELECT n.id, n.d - 1 IN (SELECT date FROM rain) AS ok, sum(CASE WHEN r.date >= n.d - 1 THEN precip_mm END) AS a,
      sum(CASE WHEN r.date >= n.d - 3 THEN precip_mm END) AS b, sum(precip_mm) AS c, max(precip_mm) AS e
    FROM neg n LEFT JOIN rain r ON r.district_id = n.district_id AND r.date >= n.d - 7 AND r.date < n.d GROUP BY 1, 2) n""",
)
def rain_negatives(spark, sf):
    return negatives_with_rain(spark, sf).select("id", *V.RAIN_ALL)


@query(
    "leadlag_dataset",
    with_(INC, RAIN, KEYRAIN, INCRAIN, NEGATIVES_SQL, LEADLAG_SQL)
    + """SELECT row_id, district_id, strftime(sample_date, '%Y-%m-%d') AS sample_date,
      rain_1d, rain_3d, rain_7d, rain_peak_7d, label FROM leadlag""",
)
def leadlag_dataset(spark, sf):
    return leadlag(spark, sf).withColumn("sample_date", day_text("sample_date"))


@query(
    "leadlag_assertions",
    with_(INC, RAIN, KEYRAIN, INCRAIN, NEGATIVES_SQL, LEADLAG_SQL)
    + """, r AS (SELECT 'label in {0,1}' AS rule, count(*) AS e, count(*) FILTER (label NOT IN (0, 1)) AS u FROM leadlag
      UNION ALL SELECT 'rain not null', count(*), count(*) FILTER (rain_1d IS NULL OR rain_3d IS NULL OR rain_7d IS NULL) FROM leadlag
      UNION ALL SELECT 'rain_7d >= rain_3d', count(*), count(*) FILTER (rain_7d < rain_3d) FROM leadlag
      UNION ALL SELECT 'rain_3d >= rain_1d', count(*), count(*) FILTER (rain_3d < rain_1d) FROM leadlag)
    SELECT rule, '*' AS "column", e AS evaluated, u AS unexpected, u / e AS fraction, u = 0 AS success FROM r""",
)
def leadlag_assertions(spark, sf):
    return quality.report(leadlag(spark, sf), quality.leadlag_rules())


@query(
    "dataset_profile",
    with_(INC, RAIN, KEYRAIN, INCRAIN, NEGATIVES_SQL, LEADLAG_SQL)
    + """SELECT count(*) AS "rows", count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives,
      round(avg(label), 6) AS positive_rate, count(DISTINCT district_id) AS "groups", min(rain_7d) AS value_min, max(rain_7d) AS value_max
    FROM leadlag""",
)
def dataset_profile(spark, sf):
    return profile.dataset_profile(leadlag(spark, sf), "label", "district_id", "rain_7d").withColumn(
        "positive_rate", rounded("positive_rate")
    )


SEVERITY_SQL = """severity AS (
  SELECT id AS incident_id, i.incident_on, hazard_id, i.district_id, CAST(month(i.incident_on) AS INTEGER) AS month,
    CAST(isodow(i.incident_on) - 1 AS INTEGER) AS day_of_week, rain_1d, rain_3d, rain_7d, rain_peak_7d,
    CASE WHEN status = 'P' AND id % 4 >= 2 THEN 1 ELSE 0 END AS casualty,
    CASE WHEN id % 4 >= 2 THEN price END AS estimated_loss
  FROM inc i JOIN incrain r ON r.incident_id = i.id)"""

_FEATURES_OUT = "incident_id, strftime(incident_on, '%Y-%m-%d %H:%M:%S') AS incident_on, hazard_id, district_id, month, day_of_week, rain_1d, rain_3d, rain_7d, rain_peak_7d"


def _reports(spark, sf):
    """(incidents with their report, rain at them); both read the same written rows."""
    rows = stable(star.incidents(spark, sf).select("id", "hazard_id", "district_id", "incident_on", "lon", "lat", "status", "price"))
    return star.with_raw(rows), rain_at_incidents(spark, sf, samples=star.sample_points(rows))


def severity(spark, sf):
    return datasets.severity_dataset(*_reports(spark, sf))


def losses(spark, sf):
    return datasets.loss_dataset(*_reports(spark, sf))


@query(
    "severity_dataset",
    with_(INC, RAIN, KEYRAIN, INCRAIN, SEVERITY_SQL) + f"SELECT {_FEATURES_OUT}, casualty FROM severity",
)
def severity_dataset(spark, sf):
    return severity(spark, sf).withColumn("incident_on", time_text("incident_on"))


@query(
    "loss_dataset",
    with_(INC, RAIN, KEYRAIN, INCRAIN, SEVERITY_SQL)
    + f"SELECT {_FEATURES_OUT}, estimated_loss, round(ln(1 + estimated_loss), 6) AS log_loss FROM severity WHERE estimated_loss IS NOT NULL",
)
def loss_dataset(spark, sf):
    return losses(spark, sf).withColumns({"incident_on": time_text("incident_on"), "log_loss": rounded("log_loss")})


@query(
    "casualty_rate_by_hazard",
    with_(INC) + "SELECT hazard_id, round(avg(CASE WHEN status = 'P' THEN 1 ELSE 0 END), 6) AS rate, count(*) AS \"rows\" FROM inc GROUP BY 1",
)
def casualty_rate_by_hazard(spark, sf):
    rows = star.incidents(spark, sf).withColumn("casualty", (F.col("status") == "P").cast("int"))
    return profile.rate_by(rows, "hazard_id", "casualty").withColumn("rate", rounded("rate"))


# --- lists and map -------------------------------------------------------

_LIST = """SELECT id, title, title_ne, hazard_id, hazard AS hazard_title, strftime(incident_on, '%Y-%m-%d') AS incident_on,
  verified, approved, lat AS latitude, lon AS longitude, (SELECT count(*) FROM inc) AS total FROM inc ORDER BY"""


@query("incident_list", with_(INC) + f"{_LIST} inc.incident_on DESC, id LIMIT 50 OFFSET 100")
def incident_list(spark, sf):
    """Page 3, with the list total beside each row."""
    rows = star.incidents(spark, sf)
    page = listing.incident_list(rows, star.hazards(spark, sf), page=3)
    return page.select(
        "id", "title", "title_ne", F.col("hazard.id").alias("hazard_id"), F.col("hazard.title").alias("hazard_title"),
        day_text("incident_on").alias("incident_on"), "verified", "approved", "latitude", "longitude",
        listing.total(rows).scalar().alias("total"),
    )


def _undated(rows):
    return rows.withColumn("incident_on", F.when(F.pmod("id", F.lit(20)) != 0, F.col("incident_on")))


@query(
    "incident_page_after",
    with_(INC) + """, u AS (SELECT *, CASE WHEN id % 20 <> 0 THEN incident_on END AS known_on FROM inc),
    o AS (SELECT *, row_number() OVER (ORDER BY known_on DESC NULLS FIRST, id) AS place FROM u),
    n AS (SELECT count(*) AS undated FROM u WHERE known_on IS NULL),
    p AS (SELECT 'inside the undated' AS "position", undated - 20 AS last FROM n UNION ALL SELECT 'last undated', undated FROM n
      UNION ALL SELECT 'dated', undated + 500 FROM n)
    SELECT "position", id, title, hazard_id, hazard, strftime(known_on, '%Y-%m-%d') AS incident_on, lat AS latitude
    FROM o JOIN p ON place > last AND place <= last + 50""",
)
def incident_page_after(spark, sf):
    """Three pages by keyset: from inside the block without a time, from its end, and from a dated position."""
    rows = stable(_undated(star.incidents(spark, sf)))
    hazards = star.hazards(spark, sf)
    undated = rows.where("incident_on is null").agg(F.count("*")).first()[0]
    places = {"inside the undated": undated - 20, "last undated": undated, "dated": undated + 500}
    pages = []
    for name, at in zip(places, listing.positions(rows, list(places.values()))):
        pages.append(listing.incidents_after(rows, hazards, *at).withColumn("position", F.lit(name)))
    return reduce(DataFrame.unionByName, pages).select(
        "position", "id", "title", F.col("hazard.id").alias("hazard_id"), F.col("hazard.title").alias("hazard"),
        day_text("incident_on").alias("incident_on"), "latitude",
    )


@query(
    "hazard_list",
    """SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS id, o_orderpriority AS title, 'Ne ' || o_orderpriority AS title_ne,
      CASE WHEN o_orderpriority < '4' THEN 'natural' ELSE 'non natural' END AS type, '#00000' || substr(o_orderpriority, 1, 1) AS color
    FROM orders""",
)
def hazard_list(spark, sf):
    return listing.hazard_list(star.hazards(spark, sf))


@query("district_list", "SELECT n_nationkey AS id, n_name AS title FROM nation ORDER BY title, id")
def district_list(spark, sf):
    return listing.district_list(star.districts(spark, sf))


_MAP = """SELECT id, lat AS latitude, lon AS longitude, hazard AS hazard_title, '#00000' || hazard_id AS hazard_color,
  strftime(incident_on, '%Y-%m-%d') AS incident_on FROM inc"""


def _map(spark, sf):
    """Incidents on the map; every tenth has no point, as in the landed reports."""
    rows = star.incidents(spark, sf)
    located = F.pmod("id", F.lit(10)) != 9
    rows = rows.withColumns({c: F.when(located, F.col(c)) for c in ("lon", "lat")})
    return listing.incident_map(rows, star.hazards(spark, sf))


@query("incident_map", with_(INC) + _MAP + " WHERE id % 10 <> 9 AND lat <> 0 AND lon <> 0")
def incident_map(spark, sf):
    return listing.drawable(_map(spark, sf)).withColumn("incident_on", day_text("incident_on"))


@query(
    "map_legend",
    with_(INC) + f"SELECT hazard_title, min_by(hazard_color, id) AS hazard_color, min(id) AS first_id FROM ({_MAP} WHERE id % 10 <> 9) GROUP BY 1",
)
def map_legend(spark, sf):
    return listing.map_legend(_map(spark, sf))


@query(
    "map_grid_density",
    with_(INC) + """SELECT CAST(floor(lon / 0.5e0) AS INTEGER) AS bin_x, CAST(floor(lat / 0.5e0) AS INTEGER) AS bin_y, count(*) AS points,
      round(avg(lon), 6) AS center_lon, round(avg(lat), 6) AS center_lat FROM inc WHERE id % 10 <> 9 GROUP BY 1, 2""",
)
def map_grid_density(spark, sf):
    cells = listing.grid_density(listing.drawable(_map(spark, sf)), 0.5)
    return cells.withColumns({"center_lon": rounded("center_lon"), "center_lat": rounded("center_lat")})
