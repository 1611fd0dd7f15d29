"""Intake: pages, flattening, rejects, keyed writes, quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import fixed_values as V, schema
from ..functions.scalar import polymorphic_id
from ..operators import quality, rain, upsert as writes
from ..plans import star
from ..session import scratch_path, stable
from ..sources import landed, versions
from .base import INC, INCRAIN, KEYRAIN, RAIN, SQL, day_text, query, time_text, with_

AS_OF = dt.datetime(2001, 8, 1)


@query("paged_cutoff", "SELECT o_orderkey // 100 AS page, o_orderkey AS id FROM orders WHERE o_orderkey // 100 <> 3")
def paged_cutoff(spark, sf):
    """Pages of 100 reports, one of them truncated; after the real end: two empty pages that still name a next, then stale copies."""
    orders = star.table(spark, sf, "orders")
    page = F.floor(F.col("o_orderkey") / 100).alias("page")
    filled = orders.groupBy(page).agg(  # at most 100 keys per page
        F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("id")))).alias("results")
    )
    last = orders.agg(F.max(page)).scalar()
    nothing = F.filter("results", lambda r: F.lit(False))
    tail = filled.select((F.col("page") + last + 1).alias("page"), F.when(F.col("page") < 2, nothing).otherwise(F.col("results")).alias("results"))
    pages = filled.unionByName(tail).select(
        "page", F.to_json(F.struct("results", F.concat(F.lit("page"), (F.col("page") + 1).cast("string")).alias("next"))).alias("body")
    )
    cut = F.expr("left(body, length(body) - 5)")
    pages = pages.withColumn("body", F.when(F.col("page") == 3, cut).otherwise(F.col("body")))
    return landed.page_records(pages).select(
        "page", F.get_json_object("record", "$.id").cast("bigint").alias("id")
    )


@query(
    "trailing_window",
    with_(INC) + f"""SELECT id, strftime(incident_on, '%Y-%m-%d') AS incident_on, data_source FROM inc
    WHERE data_source = '{V.FEED_NAME}' AND incident_on > TIMESTAMP '2001-07-02' AND incident_on < TIMESTAMP '2001-08-01'""",
)
def trailing_window(spark, sf):
    rows = landed.trailing_window(star.incidents(spark, sf), AS_OF, V.INTAKE_DAYS)
    return rows.select("id", day_text("incident_on").alias("incident_on"), "data_source").orderBy(
        F.desc("incident_on"), "id"
    )


@query(
    "flatten_incidents",
    with_(INC) + """SELECT id, title, title_ne, hazard_id,
      strftime(incident_on, '%Y-%m-%d %H:%M:%S') AS incident_on, strftime(reported_on, '%Y-%m-%d %H:%M:%S') AS reported_on,
      verified, approved, 'desk' AS source, data_source,
      CASE WHEN id % 10 <> 9 THEN lon END AS lon, CASE WHEN id % 10 <> 9 THEN lat END AS lat,
      CASE WHEN id % 4 IN (1, 2) THEN CAST(id AS INTEGER) END AS loss_id,
      strftime(reported_on, '%Y-%m-%d %H:%M:%S') AS created_on,
      strftime(reported_on + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS modified_on,
      title AS raw_title FROM inc""",
)
def flatten_incidents(spark, sf):
    rows = landed.flatten(star.raw_records(star.incidents(spark, sf)))
    times = {c: time_text(c) for c in ("incident_on", "reported_on", "created_on", "modified_on")}
    return rows.withColumns({**times, "raw_title": F.get_json_object("raw_data", "$.title")}).drop("raw_data")


@query(
    "json_loss_fields",
    with_(INC) + """SELECT id, CASE WHEN id % 4 IN (1, 2) THEN CAST(id AS INTEGER) END AS loss_id,
      CASE WHEN id % 4 >= 2 THEN price END AS estimated_loss,
      CASE WHEN id % 4 = 2 AND status = 'P' THEN 1 ELSE 0 END AS deaths,
      CASE WHEN id % 4 = 3 AND status = 'P' THEN 2 ELSE 0 END AS injured FROM inc""",
)
def json_loss_fields(spark, sf):
    rows = star.with_raw(star.incidents(spark, sf)).select("id", F.get_json_object("raw_data", "$.loss").alias("loss"))
    count = lambda f: F.coalesce(F.get_json_object("loss", f"$.{f}").cast("int"), F.lit(0))
    return rows.select(
        "id",
        polymorphic_id("loss").alias("loss_id"),
        F.get_json_object("loss", "$.estimatedLoss").cast("double").alias("estimated_loss"),
        count("peopleDeathCount").alias("deaths"),
        count("peopleInjuredCount").alias("injured"),
    )


def _later(first, second):
    """Two parts of a batch, the second one arriving after the first."""
    return first.withColumn("arrival", F.lit(0)).unionByName(second.withColumn("arrival", F.lit(1)))


_DEFECTS = [
    ',"hazard":"abc"', ',"hazard":99999999999', ',"loss":{"id":"zz"}', ',"point":"nope"', ',"point":{"coordinates":["a","b"]}',
    ',"point":{"coordinates":[82.6]}', ',"hazard":{"title":"x"},"loss":{},"point":{"coordinates":[]}', "",
]


@query(
    "reject_rows",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'no id' WHEN 'signup' THEN 'bad id'
         WHEN 'view' THEN 'bad incidentOn' WHEN 'purchase' THEN 'bad verified'
         ELSE CASE event_id % 8 WHEN 0 THEN 'bad hazard' WHEN 1 THEN 'bad hazard' WHEN 2 THEN 'bad loss' WHEN 3 THEN 'bad point'
           WHEN 4 THEN 'bad point' WHEN 5 THEN 'bad point' END END AS reason FROM events""",
)
def reject_rows(spark, sf):
    """Events as reports; four of the five kinds carry a defect, the fifth one of six, an id-less object, or none."""
    kind = F.col("event_type")
    key = F.col("event_id").cast("string")
    record = F.concat(
        F.lit("{"),
        F.when(kind == "error", F.lit("")).when(kind == "signup", F.concat(F.lit('"id":"x'), key, F.lit('",'))).otherwise(
            F.concat(F.lit('"id":'), key, F.lit(","))
        ),
        F.lit('"verified":'), F.when(kind == "purchase", F.lit('"perhaps"')).otherwise(F.lit("true")),
        F.lit(',"incidentOn":"'),
        F.when(kind == "view", F.lit("last week")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")),
        F.lit('"'),
        F.element_at(F.array(*[F.lit(d) for d in _DEFECTS]), (F.pmod("event_id", F.lit(8)) + 1).cast("int")),
        F.lit("}"),
    )
    return landed.with_reason(star.table(spark, sf, "events").select("event_id", record.alias("record"))).select(
        "event_id", "reason"
    )


@query(
    "upsert_hazards",
    """WITH h AS (SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS id, o_orderpriority AS t FROM orders)
    SELECT id, CASE WHEN id <= 4 THEN 'new ' || t ELSE t END AS title, 'Ne ' || t AS title_ne,
      CASE WHEN id <= 4 THEN 'revised' ELSE 'non natural' END AS type, '#00000' || id AS color, 'icon-' || id AS icon_url FROM h
    UNION ALL
    SELECT id + 10, 'new ' || t, 'changed', 'revised', 'changed', 'changed' FROM h WHERE id <= 4""",
)
def upsert_hazards(spark, sf):
    stored = star.hazards(spark, sf)
    edits = stored.where("id <= 4").select(
        "id", F.concat(F.lit("new "), "title").alias("title"), F.lit("changed").alias("title_ne"),
        F.lit("revised").alias("type"), F.lit("changed").alias("color"), F.lit("changed").alias("icon_url"),
    )
    batch = edits.unionByName(edits.withColumn("id", F.col("id") + 10))
    stale = batch.withColumn("title", F.lit("stale"))
    return writes.upsert(stored, _later(stale, batch), *schema.UPSERT_RULES["hazards"])


@query(
    "upsert_districts",
    """SELECT n_nationkey AS id, n_name || ' of ' || r_name AS title, 'Ne ' || n_name AS title_ne,
      'D' || n_nationkey AS code, n_regionkey AS province_id FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL
    SELECT 100 + n_nationkey, n_name || ' of ' || r_name, 'changed', 'changed', 0
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def upsert_districts(spark, sf):
    """The batch arrives as landed pages of 20 and goes through the page reader; later pages repeat every record anew."""
    regions = star.table(spark, sf, "region").select(F.col("r_regionkey").alias("province_id"), "r_name")
    stored = star.districts(spark, sf)
    title = F.concat_ws(" of ", "title", "r_name").alias("title")
    changed = F.lit("changed")
    edits = stored.join(regions, "province_id").select(
        F.explode(F.array(F.col("id"), F.col("id") + 100)).alias("id"), title
    )
    record = F.struct("id", "title", changed.alias("title_ne"), changed.alias("code"), F.lit(0).alias("province"))
    stale = edits.withColumn("title", F.lit("stale")).withColumn("page", F.floor(F.col("id") / 20))
    newest = edits.withColumn("page", F.floor(F.col("id") / 20) + 10)
    pages = stale.unionByName(newest).groupBy("page").agg(
        F.sort_array(F.collect_list(record)).alias("results")
    ).select("page", F.to_json(F.struct("results", F.lit("more").alias("next"))).alias("body"))
    batch = landed.flatten_districts(landed.page_records(pages))
    return writes.upsert(stored, batch, *schema.UPSERT_RULES["districts"])


@query(
    "upsert_municipalities",
    """SELECT CAST(c_custkey AS INTEGER) AS id, CASE WHEN c_acctbal < 0 THEN 'renamed ' || c_name ELSE c_name END AS title,
      'Ne ' || c_name AS title_ne, c_mktsegment AS type, 'M' || c_custkey AS code, c_nationkey AS district_id FROM customer""",
)
def upsert_municipalities(spark, sf):
    renamed = star.table(spark, sf, "customer").where("c_acctbal < 0").select(
        F.col("c_custkey").cast("int").alias("id"), F.concat(F.lit("renamed "), "c_name").alias("title"),
        F.lit("changed").alias("title_ne"), F.lit("changed").alias("type"), F.lit("changed").alias("code"),
        F.lit(0).alias("district_id"),
    )
    stale = renamed.withColumn("title", F.lit("stale"))
    return writes.upsert(star.municipalities(spark, sf), _later(stale, renamed), *schema.UPSERT_RULES["municipalities"])


@query(
    "upsert_incidents",
    with_(INC) + """SELECT id,
      CASE status WHEN 'O' THEN title WHEN 'F' THEN 'v1 ' || id ELSE 'v2 ' || id END AS title,
      CASE status WHEN 'O' THEN false WHEN 'F' THEN true ELSE NULL END AS verified,
      approved, hazard_id, strftime(CASE WHEN status <> 'F' OR id % 5 <> 0 THEN reported_on END + CASE status WHEN 'O' THEN INTERVAL 0 DAY WHEN 'F' THEN INTERVAL 1 DAY ELSE INTERVAL 2 DAY END,
        '%Y-%m-%d %H:%M:%S') AS modified_on FROM inc
    UNION ALL
    SELECT -1 - id, 'v2 ' || id, NULL, approved, 8, strftime(reported_on + INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') FROM inc WHERE status = 'P'""",
)
def upsert_incidents(spark, sf):
    """The batch holds three versions of every P report under its own id and under a new id, and one of every F report.

    The oldest versions, and a part of the F reports, have no modification time.
    """
    stored, batch = _stored_and_batch(spark, sf)
    return _told(writes.upsert(stored, batch, *schema.UPSERT_RULES["incidents"], order="modified_on"))


_KEPT = ["id", "title", "verified", "approved", "hazard_id", "modified_on", "raw_data"]


def _told(rows):
    return rows.select(*_KEPT[:5], time_text("modified_on").alias("modified_on"))


def _stored_and_batch(spark, sf):
    keep = _KEPT
    rows = star.with_raw(star.incidents(spark, sf)).withColumn("modified_on", F.col("reported_on"))
    stored = rows.select(*keep)

    def version(n, source, verified):
        undated = (F.lit(n) == 0) | ((F.col("status") == "F") & (F.pmod("number", F.lit(5)) == 0))
        modified = F.when(~undated, F.col("reported_on") + F.expr(f"interval {n} day"))
        return source.select(
            "id", F.concat(F.lit(f"v{n} "), F.col("number").cast("string")).alias("title"), verified.alias("verified"), "approved",
            F.lit(8 + n).alias("hazard_id"), modified.alias("modified_on"), "raw_data",
        )

    rows = rows.withColumn("number", F.col("id"))
    again = rows.where("status = 'P'")
    fresh = again.withColumn("id", -1 - F.col("id"))
    null = F.lit(None).cast("boolean")
    batch = version(2, again, null).unionByName(version(1, rows.where("status <> 'O'"), F.lit(True)))
    batch = batch.unionByName(version(2, fresh, null)).unionByName(version(1, fresh, F.lit(True)))
    batch = batch.unionByName(version(0, again, F.lit(False))).unionByName(version(0, fresh, F.lit(False)))
    return stored, batch


@query("upsert_versioned", SQL["upsert_incidents"])
def upsert_versioned(spark, sf):
    """The same write into a versioned table of hash buckets, in two steps: new versions of stored reports, then new reports."""
    stored, batch = _stored_and_batch(spark, sf)
    path, mutable = scratch_path(spark, "incidents"), schema.UPSERT_RULES["incidents"][1]
    versions.create(stored, path, ["id"], versions.by_hash(["id"], 16))
    for part in (batch.where("id >= 0"), batch.where("id < 0")):
        versions.merge(spark, path, part, mutable, "modified_on")
    return _told(versions.read(spark, path))


_ORDER_RAIN = """q AS (SELECT l_orderkey, sum(l_quantity) AS s, max(l_quantity) AS m FROM lineitem GROUP BY 1)"""


@query(
    "upsert_incident_rain",
    f"WITH {_ORDER_RAIN}" + """
    SELECT o_orderkey AS incident_id, strftime(o_orderdate, '%Y-%m-%d') AS incident_date,
      coalesce(m, 1e0) AS rain_1d, coalesce(s, 2e0) AS rain_3d, coalesce(s, 3e0) AS rain_7d, o_totalprice AS rain_peak_7d
    FROM orders LEFT JOIN q ON o_orderkey = l_orderkey""",
)
def upsert_incident_rain(spark, sf):
    """Stored rain per order, rewritten from its line items; the peak is not in the write rule and survives."""
    stored = star.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("incident_id"), F.to_date("o_orderdate").alias("incident_date"),
        F.lit(1.0).alias("rain_1d"), F.lit(2.0).alias("rain_3d"), F.lit(3.0).alias("rain_7d"),
        F.col("o_totalprice").alias("rain_peak_7d"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"),
    )
    fetched = star.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("incident_id")).agg(
        F.max("l_quantity").alias("rain_1d"), F.sum("l_quantity").alias("rain_3d"), F.sum("l_quantity").alias("rain_7d"),
        F.max("l_shipdate").cast("timestamp").alias("fetched_at"),
    ).withColumns({"incident_date": F.lit(None).cast("date"), "rain_peak_7d": F.lit(None).cast("double")})
    known = fetched.join(stored.select("incident_id"), "incident_id", "left_semi")
    stale = known.withColumns({c: F.lit(-1.0) for c in V.RAIN_SUMS})
    done = writes.upsert(stored, _later(stale, known), *schema.UPSERT_RULES["incident_rain"])
    return done.select("incident_id", day_text("incident_date").alias("incident_date"), *V.RAIN_ALL)


_WINDOWS = """w AS (SELECT district_id, date,
    sum(precip_mm) OVER (PARTITION BY district_id ORDER BY date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS rain_1d,
    sum(precip_mm) OVER (PARTITION BY district_id ORDER BY date RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS rain_3d,
    sum(precip_mm) OVER (PARTITION BY district_id ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS rain_7d,
    max(precip_mm) OVER (PARTITION BY district_id ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS rain_peak_7d
  FROM rain)"""


@query(
    "upsert_daily_rain",
    with_(RAIN, _WINDOWS) + """SELECT district_id, strftime(date, '%Y-%m-%d') AS sample_date,
      CASE WHEN date >= DATE '2000-01-01' THEN 2 * rain_1d ELSE rain_1d END AS rain_1d,
      CASE WHEN date >= DATE '2000-01-01' THEN 2 * rain_3d ELSE rain_3d END AS rain_3d,
      CASE WHEN date >= DATE '2000-01-01' THEN 2 * rain_7d ELSE rain_7d END AS rain_7d,
      CASE WHEN date >= DATE '2000-01-01' THEN 2 * rain_peak_7d ELSE rain_peak_7d END AS rain_peak_7d FROM w
    UNION ALL
    SELECT 1000 + district_id, strftime(date, '%Y-%m-%d'), 2 * rain_1d, 2 * rain_3d, 2 * rain_7d, 2 * rain_peak_7d FROM w
    WHERE date >= DATE '2000-01-01'""",
)
def upsert_daily_rain(spark, sf):
    """Composite key (district, day): recent days are rewritten, other districts' days are new."""
    stored = rain.panel_windows(star.daily_panel(spark, sf), ["district_id"], "date", "precip_mm").select(
        "district_id", F.col("date").alias("sample_date"),
        *[F.col(c).cast("decimal(12,4)").alias(c) for c in V.RAIN_ALL], F.lit(0).alias("ingested_at"),
    )
    edits = stored.where("sample_date >= '2000-01-01'").select(
        "district_id", "sample_date", *[(F.col(c) * 2).cast("decimal(12,4)").alias(c) for c in V.RAIN_ALL], F.lit(1).alias("ingested_at")
    )
    batch = edits.unionByName(edits.withColumn("district_id", F.col("district_id") + 1000))
    batch = _later(batch.withColumns({c: F.lit(-1).cast("decimal(12,4)") for c in V.RAIN_ALL}), batch)
    done = writes.upsert(stored, batch, *schema.UPSERT_RULES["district_daily_rain"])
    return done.select(
        "district_id", day_text("sample_date").alias("sample_date"), *[F.col(c).cast("double").alias(c) for c in V.RAIN_ALL]
    )


@query(
    "update_peak",
    with_(INC, RAIN, KEYRAIN, INCRAIN) + """SELECT incident_id, strftime(incident_date, '%Y-%m-%d') AS incident_date, rain_7d,
      rain_peak_7d FROM incrain""",
)
def update_peak(spark, sf):
    """Peak rain written into an existing rain table: 7-day gate, missing pixels skipped, unmatched rows dropped."""
    points, grid = stable(star.samples(spark, sf)), stable(star.rain_grid(spark, sf))
    stored = rain.at_points(points, grid, star.GEOMETRY, "incident_date", "lon", "lat", gate=1).withColumn(
        "rain_peak_7d", F.lit(None).cast("double")
    )
    peaks = rain.at_points(points, grid, star.GEOMETRY, "incident_date", "lon", "lat", gate=V.PEAK_WINDOW)
    peaks = peaks.where("rain_peak_7d is not null").select("incident_id", "rain_peak_7d")
    done = writes.update_only(stored, peaks, ["incident_id"], ["rain_peak_7d"])
    return done.select("incident_id", day_text("incident_date").alias("incident_date"), "rain_7d", "rain_peak_7d")


# A table with every kind of defect, from events.
_DQ = """t AS (SELECT CASE WHEN event_type = 'error' AND value > 50 THEN NULL ELSE user_id END AS id,
    CAST(user_id % 50 AS INTEGER) AS hazard_id,
    CASE WHEN event_type <> 'signup' THEN ts END AS incident_on,
    CAST(event_id % 7 AS INTEGER) AS loss_id,
    CASE WHEN event_type <> 'view' THEN 26 + value / 100 END AS latitude,
    80 + value / 1000 AS longitude, event_id FROM events)"""

_DQ_REPORT = """r AS (
    SELECT 'not_null(id)' AS rule, 'id' AS col, 1e0 AS mostly, count(*) AS e, count(*) FILTER (id IS NULL) AS u FROM t
    UNION ALL SELECT 'unique(id)', 'id', 1e0, CAST(coalesce(sum(n), 0) AS BIGINT), CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT)
      FROM (SELECT count(*) AS n FROM t WHERE id IS NOT NULL GROUP BY id)
    UNION ALL SELECT 'in_set(hazard_id)', 'hazard_id', 1e0, count(hazard_id), count(*) FILTER (hazard_id NOT BETWEEN 1 AND 47) FROM t
    UNION ALL SELECT 'not_null(incident_on)', 'incident_on', 1e0, count(*), count(*) FILTER (incident_on IS NULL) FROM t
    UNION ALL SELECT 'between(loss_id)', 'loss_id', 1e0, count(loss_id), count(*) FILTER (loss_id < 1) FROM t
    UNION ALL SELECT 'between(latitude)', 'latitude', 0.98e0, count(latitude), count(*) FILTER (latitude NOT BETWEEN 26.3e0 AND 30.5e0) FROM t
    UNION ALL SELECT 'between(longitude)', 'longitude', 0.98e0, count(longitude), count(*) FILTER (longitude NOT BETWEEN 80e0 AND 88.3e0) FROM t
    UNION ALL SELECT 'between(incident_on)', 'incident_on', 1e0, count(incident_on), count(*) FILTER (incident_on > TIMESTAMP '2024-01-30') FROM t)"""
_DQ_ROWS = """SELECT rule, col AS "column", e AS evaluated, u AS unexpected, CASE WHEN e > 0 THEN round(u / e, 6) ELSE 0e0 END AS fraction,
      CASE WHEN e > 0 THEN (e - u) / e >= mostly ELSE true END AS success FROM r"""


def _dq_table(spark, sf):
    e = star.table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.when(~((kind == "error") & (F.col("value") > 50)), F.col("user_id")).alias("id"),
        F.pmod("user_id", F.lit(50)).cast("int").alias("hazard_id"),
        F.when(kind != "signup", F.col("ts").cast("timestamp")).alias("incident_on"),
        F.pmod("event_id", F.lit(7)).cast("int").alias("loss_id"),
        F.when(kind != "view", 26 + F.col("value") / 100).alias("latitude"),
        (80 + F.col("value") / 1000).alias("longitude"),
        "event_id",
    )


DQ_AS_OF = dt.datetime(2024, 1, 30)


@query("dq_report", with_(_DQ, _DQ_REPORT) + _DQ_ROWS)
def dq_report(spark, sf):
    result = quality.report(_dq_table(spark, sf), quality.incident_rules(DQ_AS_OF))
    return result.withColumn("fraction", F.round("fraction", 6))


@query(
    "dq_overall",
    with_(_DQ, _DQ_REPORT) + f"SELECT count(*) AS rules, count(*) FILTER (success) AS passed, bool_and(success) AS success FROM ({_DQ_ROWS})",
)
def dq_overall(spark, sf):
    return quality.overall(quality.report(_dq_table(spark, sf), quality.incident_rules(DQ_AS_OF)))


@query(
    "dq_violations",
    with_(_DQ) + """SELECT event_id, 'not_null(id)' AS rule FROM t WHERE id IS NULL
    UNION ALL SELECT event_id, 'unique(id)' FROM t WHERE id IN (SELECT id FROM t WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)
    UNION ALL SELECT event_id, 'in_set(hazard_id)' FROM t WHERE hazard_id NOT BETWEEN 1 AND 47
    UNION ALL SELECT event_id, 'not_null(incident_on)' FROM t WHERE incident_on IS NULL
    UNION ALL SELECT event_id, 'between(loss_id)' FROM t WHERE loss_id < 1
    UNION ALL SELECT event_id, 'between(latitude)' FROM t WHERE latitude NOT BETWEEN 26.3e0 AND 30.5e0
    UNION ALL SELECT event_id, 'between(longitude)' FROM t WHERE longitude NOT BETWEEN 80e0 AND 88.3e0
    UNION ALL SELECT event_id, 'between(incident_on)' FROM t WHERE incident_on > TIMESTAMP '2024-01-30'""",
)
def dq_violations(spark, sf):
    return quality.violations(_dq_table(spark, sf), quality.incident_rules(DQ_AS_OF), ["event_id"])
