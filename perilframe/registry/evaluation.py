"""Splits, thresholds, encodings, metrics, score requests."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalar as S
from ..operators import encode, metrics, order_stats, profile, splits, thresholds
from ..plans import requests, runlog, star
from ..session import stable
from .base import COUNTS, GRID, INC, INCRAIN, KEYRAIN, PANEL, RAIN, day_text, query, rounded, with_
from .tables import LEADLAG_SQL, NEGATIVES_SQL, SEVERITY_SQL, built_panel, leadlag, losses

HASH = "((o_orderkey % 2147483647) * 2654435761 + {seed}) % 4294967296"


# --- splits --------------------------------------------------------------


@query(
    "split_last_periods",
    with_(INC, COUNTS, GRID, PANEL) + """SELECT district, hazard, year, month, incident_count,
      year * 12 + month >= (SELECT min(p) FROM (SELECT DISTINCT year * 12 + month AS p FROM panel ORDER BY p DESC LIMIT 3)) AS is_test FROM panel""",
)
def split_last_periods(spark, sf):
    marked = splits.mark_last_periods(stable(built_panel(spark, sf)))
    return marked.select("district", "hazard", "year", "month", "incident_count", "is_test")


@query(
    "split_recent_dates",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 11 <> 0),
    c AS (SELECT min(d) AS cut FROM (SELECT d, row_number() OVER (ORDER BY d DESC) AS rn FROM d)
      WHERE rn <= greatest(1, CAST(floor((SELECT count(*) FROM d) * 0.2e0) AS BIGINT)))
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS sample_date,
      o_orderkey % 11 <> 0 AND CAST(o_orderdate AS DATE) >= cut AS is_test FROM orders, c""",
)
def split_recent_dates(spark, sf):
    """Every eleventh row has no date and trains."""
    dated = F.when(F.pmod("o_orderkey", F.lit(11)) != 0, F.to_date("o_orderdate"))
    rows = star.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), dated.alias("sample_date"))
    return splits.mark_recent_dates(rows, "sample_date").withColumn("sample_date", day_text("sample_date"))


@query(
    "split_recent_rows",
    """SELECT o_orderkey AS id, rn <= greatest(1, CAST(floor(n * 0.2e0) AS BIGINT)) AS is_test FROM (
      SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, count(*) OVER () AS n FROM orders)""",
)
def split_recent_rows(spark, sf):
    rows = star.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("incident_on")
    )
    return splits.mark_recent_rows(rows, "incident_on", "id").select("id", "is_test")


_STRATIFIED = f"""SELECT o_orderkey AS id, label, rn <= CAST(floor(n * 0.2e0 + 0.5e0) AS BIGINT) AS is_test FROM (
  SELECT o_orderkey, label, row_number() OVER (PARTITION BY label ORDER BY h, o_orderkey) AS rn, count(*) OVER (PARTITION BY label) AS n
  FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS label, {HASH.format(seed=42)} AS h FROM orders))"""


@query("split_stratified", _STRATIFIED)
def split_stratified(spark, sf):
    return splits.mark_stratified(star.scored(spark, sf).select("id", "label"), "label", "id")


@query(
    "cv_folds",
    f"SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS label, CAST((({HASH.format(seed=43)}) // 65536) % 5 AS INTEGER) AS fold FROM orders",
)
def cv_folds(spark, sf):
    return splits.with_fold(star.scored(spark, sf).select("id", "label"), "id")


# --- quantiles, thresholds ----------------------------------------------

_RAIN_TABLE = with_(INC, RAIN, KEYRAIN, INCRAIN, NEGATIVES_SQL, LEADLAG_SQL)


@query(
    "threshold_candidates",
    _RAIN_TABLE + ", p AS (SELECT CAST(unnest(generate_series(5, 95, 5)) AS INTEGER) AS percent)\n"
    + "\nUNION ALL ".join(
        f"SELECT '{f}' AS feature, percent, round(qs[percent // 5], 6) AS threshold FROM p, (SELECT quantile_cont({f}, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS qs FROM leadlag)"
        for f in V.RAIN_SUMS
    ),
)
def threshold_candidates(spark, sf):
    rows = stable(leadlag(spark, sf))
    found = [(f, p, t) for f, cuts in thresholds.candidates(rows, V.RAIN_SUMS).items() for p, t in zip(V.THRESHOLD_PERCENTS, cuts)]
    return spark.createDataFrame(found, "feature string, percent int, threshold double").withColumn(
        "threshold", rounded("threshold")
    )


@query(
    "threshold_scores",
    with_("s AS (SELECT (o_orderkey * 7919 % 1000) / 1000.0e0 AS score, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS label FROM orders)",
          "c AS (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS position, unnest([0.1e0, 0.25e0, 0.5e0, 0.9e0]) AS threshold)")
    + """SELECT position, threshold, tp, fp, fn, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0e0 END AS f1
    FROM (SELECT position, threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp,
      count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn
      FROM s, c GROUP BY 1, 2)""",
)
def threshold_scores(spark, sf):
    done = thresholds.score_candidates(star.scored(spark, sf), {"score": [0.1, 0.25, 0.5, 0.9]})
    return done.drop("feature").withColumn("f1", rounded("f1"))


def _feature_search(f):
    return f"""SELECT '{f}' AS feature, round(threshold, 6) AS threshold, round(train_f1, 6) AS train_f1,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
  (SELECT round(sum(pos * (nb + neg / 2.0e0)) / (sum(pos) * sum(neg)), 6) FROM z_{f}) AS roc_auc,
  (SELECT round(sum(pos * (tp_at / (tp_at + fp_at))) / sum(pos), 6) FROM z_{f}) AS average_precision
FROM (SELECT threshold, train_f1, count(*) FILTER ({f} >= threshold AND label = 1) AS tp,
    count(*) FILTER ({f} >= threshold AND label = 0) AS fp, count(*) FILTER ({f} < threshold AND label = 1) AS fn
  FROM marked, (SELECT threshold, f1 AS train_f1 FROM (
      SELECT threshold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM (
        SELECT threshold, count(*) FILTER ({f} >= threshold AND label = 1) AS tp, count(*) FILTER ({f} >= threshold AND label = 0) AS fp,
          count(*) FILTER ({f} < threshold AND label = 1) AS fn
        FROM marked, (SELECT DISTINCT unnest(qs) AS threshold FROM (SELECT quantile_cont({f}, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS qs FROM marked WHERE NOT is_test))
        WHERE NOT is_test GROUP BY 1)) ORDER BY f1 DESC, threshold LIMIT 1) WHERE is_test GROUP BY 1, 2)"""


def _score_steps(f):
    return f"""z_{f} AS (SELECT pos, neg, sum(neg) OVER (ORDER BY v) - neg AS nb,
  sum(pos) OVER (ORDER BY v DESC) AS tp_at, sum(neg) OVER (ORDER BY v DESC) AS fp_at
  FROM (SELECT {f} AS v, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM marked WHERE is_test GROUP BY 1))"""


_MARKED = """marked AS (SELECT *, rn <= CAST(floor(n * 0.2e0 + 0.5e0) AS BIGINT) AS is_test FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY ((row_id % 2147483647) * 2654435761 + 42) % 4294967296, row_id) AS rn,
    count(*) OVER (PARTITION BY label) AS n FROM leadlag))"""


@query(
    "threshold_search",
    with_(INC, RAIN, KEYRAIN, INCRAIN, NEGATIVES_SQL, LEADLAG_SQL, _MARKED, *[_score_steps(f) for f in V.RAIN_SUMS])
    + "\nUNION ALL ".join(_feature_search(f) for f in V.RAIN_SUMS),
)
def threshold_search(spark, sf):
    train, test = splits.halves(stable(splits.mark_stratified(stable(leadlag(spark, sf)), "label", "row_id")))
    done = thresholds.search(train, test)
    return done.select("feature", *[rounded(c).alias(c) for c in done.columns if c != "feature"])


@query(
    "majority_baseline",
    """SELECT 0e0 AS f1, round(1 - count(*) FILTER (o_orderstatus = 'P') / count(*), 6) AS accuracy FROM orders""",
)
def majority_baseline(spark, sf):
    return metrics.majority_baseline(star.scored(spark, sf)).withColumn("accuracy", rounded("accuracy"))


_LOSS_SPLIT = """l AS (SELECT *, ln(1 + estimated_loss) AS log_loss FROM severity WHERE estimated_loss IS NOT NULL),
ls AS (SELECT *, row_number() OVER (ORDER BY incident_on DESC, incident_id DESC) > greatest(1, CAST(floor(count(*) OVER () * 0.2e0) AS BIGINT)) AS train FROM l)"""


@query(
    "loss_tiers",
    with_(INC, RAIN, KEYRAIN, INCRAIN, SEVERITY_SQL, _LOSS_SPLIT)
    + """SELECT NOT train AS is_test, CAST(CASE WHEN log_loss <= e0 THEN 0 WHEN log_loss <= e1 THEN 1 ELSE 2 END AS INTEGER) AS tier,
      count(*) AS "rows", round(min(log_loss), 6) AS low, round(max(log_loss), 6) AS high
    FROM ls, (SELECT quantile_cont(log_loss, 1 / 3.0e0) AS e0, quantile_cont(log_loss, 2 / 3.0e0) AS e1 FROM ls WHERE train) GROUP BY 1, 2""",
)
def loss_tiers(spark, sf):
    """Tercile edges from train only; rows per tier on both sides."""
    marked = stable(splits.mark_recent_rows(stable(losses(spark, sf)), "incident_on", "incident_id"))
    edges = order_stats.quantiles(marked.where("not is_test"), "log_loss", [1 / 3, 2 / 3])
    return marked.groupBy("is_test", S.tier("log_loss", edges).alias("tier")).agg(
        F.count("*").alias("rows"), rounded(F.min("log_loss")).alias("low"), rounded(F.max("log_loss")).alias("high")
    )


_RATE = 0.335


@query(
    "tautological_filter",
    f"""WITH t AS (SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS hazard_id,
      CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS label, o_orderdate AS seen FROM orders)
    SELECT id, hazard_id, label FROM t WHERE hazard_id NOT IN (
      SELECT hazard_id FROM t GROUP BY 1 HAVING avg(label) > {_RATE} AND hazard_id IN (SELECT hazard_id FROM t WHERE seen < TIMESTAMP '2000-01-01'))""",
)
def tautological_filter(spark, sf):
    """Hazards above the rate over all rows, and seen in train, leave the table."""
    rows = star.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), star.hazard_number().alias("hazard_id"),
        (F.col("o_orderstatus") == "P").cast("int").alias("label"), "o_orderdate",
    )
    train = rows.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    sure = profile.tautological(rows, train, "hazard_id", "label", _RATE)
    return profile.drop_groups(rows, sure, "hazard_id").select("id", "hazard_id", "label")


# --- encodings -----------------------------------------------------------


@query(
    "label_encode",
    with_(INC) + """SELECT id, district, CAST(dense_rank() OVER (ORDER BY district) - 1 AS INTEGER) AS district_encoded,
      hazard, CAST(dense_rank() OVER (ORDER BY hazard) - 1 AS INTEGER) AS hazard_encoded FROM inc""",
)
def label_encode(spark, sf):
    names = star.districts(spark, sf).select(F.col("id").alias("district_id"), F.col("title").alias("district"))
    rows = stable(star.incidents(spark, sf).join(names, "district_id").select("id", "district", F.col("hazard").alias("hazard")))
    codes = encode.label_positions(rows, ["district", "hazard"])
    return rows.withColumns({f"{c}_encoded": code for c, code in codes.items()})


@query(
    "one_hot",
    """WITH v AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS t FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey < 20),
    k AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS slot FROM v)
    SELECT c_custkey AS id, c_nationkey AS district_id, CAST(coalesce(slot, -1) AS INTEGER) AS hot,
      CASE WHEN slot IS NULL THEN 0e0 ELSE 1e0 END AS total, (SELECT CAST(count(*) AS INTEGER) FROM k) AS width
    FROM customer LEFT JOIN k ON t = CAST(c_nationkey AS VARCHAR)""",
)
def one_hot(spark, sf):
    """Vocabulary from the customers of 20 nations; the other nations are unseen and become all zeros."""
    rows = star.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("district_id"), "c_mktsegment"
    )
    model = encode.fit_one_hot(rows.where("c_mktsegment <> 'BUILDING' and district_id < 20"), "district_id")
    vec = vector_to_array("district_id_vec")
    return encode.apply_one_hot(model, rows, "district_id").select(
        "id", "district_id", (F.array_position(vec, F.lit(1.0)) - 1).cast("int").alias("hot"),
        F.aggregate(vec, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(vec).alias("width"),
    )


@query(
    "standard_scale",
    """SELECT o_orderkey AS id, round((o_totalprice - m) / s, 6) AS price_scaled FROM orders,
      (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderstatus <> 'P')""",
)
def standard_scale(spark, sf):
    rows = star.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), "o_orderstatus"
    )
    stats = encode.fit_scale(rows.where("o_orderstatus <> 'P'"), ["price"])
    return encode.apply_scale(rows, stats).select("id", rounded("price_scaled").alias("price_scaled"))


# --- metrics -------------------------------------------------------------

_SCORES = """s AS (SELECT (o_orderkey * 7919 % 1000) / 1000.0e0 AS score, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS label FROM orders),
g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM s GROUP BY 1),
w AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS nb, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g)"""


@query("roc_auc", with_(_SCORES) + "SELECT round(sum(pos * (nb + neg / 2.0e0)) / (sum(pos) * sum(neg)), 9) AS roc_auc FROM w")
def roc_auc(spark, sf):
    return metrics.roc_auc(star.scored(spark, sf)).select(rounded("roc_auc", 9).alias("roc_auc"))


@query(
    "average_precision",
    with_(_SCORES) + "SELECT round(sum(pos * (tp / (tp + fp))) / sum(pos), 9) AS average_precision FROM w",
)
def average_precision(spark, sf):
    return metrics.average_precision(star.scored(spark, sf)).select(
        rounded("average_precision", 9).alias("average_precision")
    )


@query(
    "prf_at_threshold",
    with_(_SCORES) + """SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall,
      round(2 * tp / (2 * tp + fp + fn), 6) AS f1
    FROM (SELECT count(*) FILTER (score >= 0.5e0 AND label = 1) AS tp, count(*) FILTER (score >= 0.5e0 AND label = 0) AS fp,
      count(*) FILTER (score < 0.5e0 AND label = 1) AS fn FROM s)""",
)
def prf_at_threshold(spark, sf):
    done = metrics.prf_at(star.scored(spark, sf))
    return done.select("tp", "fp", "fn", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")])


_REG = """p AS (SELECT o_totalprice AS actual, o_totalprice * 0.9e0 + o_orderkey % 100 AS predicted FROM orders)"""


@query(
    "regression_metrics",
    with_(_REG) + """SELECT count(*) AS n, round(avg(abs(actual - predicted)), 4) AS mae,
      round(sqrt(avg((actual - predicted) * (actual - predicted))), 4) AS rmse,
      round(1 - avg((actual - predicted) * (actual - predicted)) / var_pop(actual), 6) AS r2 FROM p""",
)
def regression_metrics(spark, sf):
    done = metrics.regression_metrics(star.scored(spark, sf))
    return done.select("n", rounded("mae", 4).alias("mae"), rounded("rmse", 4).alias("rmse"), rounded("r2").alias("r2"))


@query(
    "multiclass_metrics",
    """WITH p AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS a, o_orderkey % 5 + 1 AS p FROM orders),
    c AS (SELECT k, count(*) FILTER (a = k) AS n, count(*) FILTER (p = k) AS s, count(*) FILTER (a = k AND p = k) AS h
      FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) GROUP BY 1)
    SELECT round(sum(h) / sum(n), 6) AS accuracy, round(avg(2 * h / (n + s)), 6) AS f1_macro FROM c""",
)
def multiclass_metrics(spark, sf):
    done = metrics.multiclass_metrics(star.scored(spark, sf), "class_actual", "class_predicted")
    return done.select(rounded("accuracy").alias("accuracy"), rounded("f1_macro").alias("f1_macro"))


@query(
    "back_transformed_mae",
    "SELECT round(avg(abs(o_totalprice - (exp(ln(1 + o_totalprice) * 0.98e0) - 1))), 4) AS mae_real FROM orders",
)
def back_transformed_mae(spark, sf):
    rows = star.table(spark, sf, "orders").select(
        "o_totalprice", (F.log1p("o_totalprice") * 0.98).alias("predicted_log")
    )
    return metrics.back_transformed_mae(rows, "o_totalprice", "predicted_log").select(
        rounded("mae_real", 4).alias("mae_real")
    )


# --- runs and requests ---------------------------------------------------


@query(
    "latest_run",
    """SELECT event_type AS name, max_by(CAST(event_id AS VARCHAR), struct_pack(t := ts, e := CAST(event_id AS VARCHAR))) AS run_id FROM events GROUP BY 1""",
)
def latest_run(spark, sf):
    """Events as a run log: the newest run of every name."""
    log = star.table(spark, sf, "events").select(
        F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("run_id"),
        F.col("ts").cast("timestamp").alias("start_time"),
    )
    return runlog.latest(log).select("name", "run_id")


@query(
    "score_rejects",
    """SELECT o_orderkey AS id,
      CASE WHEN o_orderkey % 11 = 0 OR o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN 'missing field'
           WHEN o_orderkey % 5 = 0 THEN 'year and month must be integers'
           WHEN o_orderkey % 3 = 0 THEN 'unknown district or hazard' END AS reason FROM orders""",
)
def score_rejects(spark, sf):
    """Count requests from orders; some lack a field, name no integer month, or an unknown district."""
    k = F.col("o_orderkey")
    customers = star.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k"))
    names = star.districts(spark, sf).select(F.col("id").alias("k"), F.col("title").alias("name"))
    asked = star.table(spark, sf, "orders").join(customers, "o_custkey").join(names, "k").select(
        k.alias("id"),
        F.when(k % 3 == 0, F.lit("Atlantis")).otherwise(F.col("name")).alias("district"),
        F.when(k % 11 != 0, F.col("o_orderpriority")).otherwise(F.lit("")).alias("hazard"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.when((F.col("o_orderstatus") == "P") & (k % 7 == 0), F.lit("0"))
        .when(k % 5 == 0, F.lit("June")).otherwise(F.month("o_orderdate").cast("string")).alias("month"),
    )
    judged = requests.judge_count_requests(asked, star.districts(spark, sf), star.hazards(spark, sf))
    return judged.select("id", "reason")


@query(
    "score_rejects_hazard",
    with_(INC, RAIN) + """SELECT id, CASE WHEN id % 11 = 0 THEN 'missing field' WHEN id % 5 = 0 THEN 'date must be YYYY-MM-DD'
      WHEN id % 3 = 0 THEN 'unknown district' WHEN r.date IS NULL THEN 'no rainfall data' END AS reason
    FROM inc LEFT JOIN rain r ON r.district_id = inc.district_id AND r.date = CAST(incident_on AS DATE)""",
)
def score_rejects_hazard(spark, sf):
    names = star.districts(spark, sf).select(F.col("id").alias("district_id"), F.col("title").alias("name"))
    rows = star.incidents(spark, sf).select("id", "district_id", "incident_on").join(names, "district_id")
    asked = rows.select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("Atlantis")).otherwise(F.col("name")).alias("district"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 5 == 0, F.date_format("incident_on", "dd.MM.yyyy"))
        .otherwise(day_text("incident_on")).alias("date"),
    )
    daily = star.daily_panel(spark, sf).select(
        "district_id", F.col("date").alias("sample_date"), *[F.col("precip_mm").alias(c) for c in V.RAIN_ALL]
    )
    return requests.judge_hazard_requests(asked, star.districts(spark, sf), daily).select("id", "reason")
