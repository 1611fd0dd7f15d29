"""Tables kept up to date: late rain, the panel, sketches, checks by batch, and layouts that spare repeated work."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import fixed_values as V, schema
from ..operators import grids, late_rain, panel_refresh, pyramid, quality, quality_state, rain, sketches
from ..plans import star
from ..session import scratch_path, stable
from ..sources import landed, tables, versions
from ..streaming import closed
from .base import COUNTS, GRID, INC, INCRAIN, KEYRAIN, PANEL, RAIN, SQL, day_text, query, rounded, with_
from .intake import DQ_AS_OF, _dq_table
from .tables import _map, _PANEL_OUT

# --- late rain -----------------------------------------------------------

# Of the rain, whole days and single pixels land weeks late, and others come first with a wrong value.
_LATE_SQL = """pixel AS (
  SELECT *, date_diff('day', DATE '1970-01-01', date) AS day FROM rain),
late AS (
  SELECT *, day % 23 = 0 OR (day + 7 * (district_id % 5) + 3 * (district_id // 5)) % 13 = 0 AS missing,
    (day + 5 * (district_id % 5) + 11 * (district_id // 5)) % 17 = 0 AS wrong FROM pixel),
changed AS (SELECT district_id, date FROM late WHERE missing OR wrong),
opened AS (SELECT DISTINCT date FROM late WHERE date NOT IN (SELECT date FROM late WHERE NOT missing)),
keys AS (SELECT DISTINCT district_id, CAST(incident_on AS DATE) AS d FROM inc),
touched AS (
  SELECT DISTINCT k.district_id, k.d FROM keys k JOIN changed c ON c.district_id = k.district_id AND c.date >= k.d - 7 AND c.date < k.d
  UNION
  SELECT DISTINCT k.district_id, k.d FROM keys k JOIN opened o ON o.date >= k.d - 7 AND o.date < k.d)"""


def _landings(spark, sf):
    """(grid as first taken in, what lands later): pixels that were missing, corrections, and an older copy of each."""
    whole = stable(star.rain_grid(spark, sf))
    day = F.unix_date("date")
    missing = (day % 23 == 0) | ((day + 7 * F.col("cell_x") + 3 * F.col("cell_y")) % 13 == 0)
    wrong = (day + 5 * F.col("cell_x") + 11 * F.col("cell_y")) % 17 == 0
    first = whole.where(~missing).withColumn("precip_mm", F.col("precip_mm") + wrong.cast("int"))
    late = whole.where(missing | wrong).select("*", F.date_add("date", 40).alias("landed_at"))
    older = late.select("cell_x", "cell_y", "date", F.lit(0.0).alias("precip_mm"), F.date_add("date", 30).alias("landed_at"))
    return stable(first), stable(late.unionByName(older))


AT = dt.datetime(2002, 1, 1)


def _first_rain(spark, sf, samples, grid):
    found = rain.at_points(samples, grid, star.GEOMETRY, "incident_date", "lon", "lat", gate=1)
    return found.select("incident_id", "incident_date", *V.RAIN_ALL, F.lit(None).cast("timestamp").alias("fetched_at"))


@query(
    "late_rain_refresh",
    with_(INC, RAIN, KEYRAIN, INCRAIN) + """SELECT incident_id, strftime(incident_date, '%Y-%m-%d') AS incident_date,
      rain_1d, rain_3d, rain_7d, rain_peak_7d FROM incrain""",
)
def late_rain_refresh(spark, sf):
    """Rain at incidents from a stored grid with holes and errors, refreshed when pixels land weeks late: as if they had been there."""
    grid, arrived = _landings(spark, sf)
    samples, path = stable(star.samples(spark, sf)), scratch_path(spark, "grid")
    late_rain.store_grid(grid, path)
    stored = stable(_first_rain(spark, sf, samples, grid))
    done, _ = late_rain.refresh_incident_rain(stored, samples, late_rain.land_stored(spark, path, arrived), star.GEOMETRY, AT)
    return done.select("incident_id", day_text("incident_date").alias("incident_date"), *V.RAIN_ALL)


@query(
    "late_rain_touched",
    with_(INC, RAIN, _LATE_SQL) + """SELECT (SELECT count(*) FROM changed) AS changed_pixels, (SELECT count(*) FROM opened) AS opened_days,
      (SELECT count(*) FROM touched) AS touched_keys, (SELECT count(*) FROM keys) AS all_keys""",
)
def late_rain_touched(spark, sf):
    """How many of the (cell, day) keys of the incidents the landing makes the refresh look up again."""
    grid, arrived = _landings(spark, sf)
    landing = late_rain.land(grid, arrived)
    located = star.samples(spark, sf).select("incident_date", *star.GEOMETRY.cells("lon", "lat"))
    keys = stable(located.distinct())
    touched = late_rain.touched_keys(keys, landing.changed, landing.opened, "incident_date", V.PEAK_WINDOW)
    count = lambda df: df.agg(F.count("*")).scalar()
    return touched.agg(F.count("*").alias("touched_keys")).select(
        count(landing.changed).alias("changed_pixels"), count(landing.opened).alias("opened_days"), "touched_keys", count(keys).alias("all_keys")
    )


@query("late_daily_rain_refresh", SQL["daily_rain"])
def late_daily_rain_refresh(spark, sf):
    """The district-day rain table after the same landing."""
    grid, arrived = _landings(spark, sf)
    points = stable(rain.centroids(star.incidents(spark, sf), "district_id", "lon", "lat", "id"))
    days = stable(star.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("sample_date")).distinct())
    stored = stable(
        rain.daily_rain(points, grid, star.GEOMETRY, days, "district_id").withColumn("ingested_at", F.lit(None).cast("timestamp"))
    )
    done, _ = late_rain.refresh_daily_rain(stored, points, days, late_rain.land(grid, arrived), star.GEOMETRY, AT)
    return done.select("district_id", day_text("sample_date").alias("sample_date"), *V.RAIN_ALL)


# --- panel ---------------------------------------------------------------


@query("panel_refresh", with_(INC, COUNTS, GRID, PANEL) + _PANEL_OUT)
def panel_refresh_(spark, sf):
    """The panel of early reports, patched by two landings: later periods with a new hazard, then reports late in all periods.

    The panel is a versioned table in buckets of a period; a landing rewrites the periods it touches.
    """
    rows = star.incidents(spark, sf)
    places, kinds = star.districts(spark, sf), star.hazards(spark, sf)
    late, early = F.col("status") == "P", (F.col("incident_on") < "2000-01-01") & (F.col("hazard_id") != 5)
    state = panel_refresh.build(stable(grids.full_grid(stable(grids.monthly_counts(rows.where(~late & early), places, kinds)))))
    path = scratch_path(spark, "panel")
    versions.create(state.cells, path, grids.CELL, "year * 12 + month")
    for landing in (rows.where(~late & ~early), rows.where(late)):
        state, changed = panel_refresh.refresh(state, panel_refresh.deltas(grids.monthly_counts(landing, places, kinds)))
        versions.patch(spark, path, changed)
    cells = versions.read(spark, path).where("prev_month_count is not null")
    return cells.withColumn("historical_month_avg", rounded("historical_month_avg"))


# --- sketches ------------------------------------------------------------

PROBABILITIES = [0.05, 0.25, 0.5, 0.75, 0.95]


def _sketched(spark, sf):
    """Sketches per day of the O and F reports, with those of the late P reports merged in."""
    rows = star.incidents(spark, sf).withColumn("day", F.to_date("incident_on"))
    late = F.col("status") == "P"
    make = lambda df: sketches.daily(df, "day", ["price"], ["custkey"])
    return stable(sketches.added(stable(make(rows.where(~late))), make(rows.where(late)), "day")), rows


@query(
    "sketch_quantiles",
    with_(INC) + f"""SELECT CAST(p AS DOUBLE) AS p, (SELECT count(*) FROM inc) AS n, true AS within_bound
    FROM (SELECT unnest({PROBABILITIES}) AS p)""",
)
def sketch_quantiles(spark, sf):
    """Quantiles of the loss from sketches per day, each held against the exact ranks of its value."""
    held, rows = _sketched(spark, sf)
    found = sketches.quantiles(held, "price", PROBABILITIES).collect()
    ranks = rows.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("price") < F.lit(r["value"])).alias(f"below{i}") for i, r in enumerate(found)],
        *[F.count_if(F.col("price") <= F.lit(r["value"])).alias(f"upto{i}") for i, r in enumerate(found)],
    )
    out = []
    for i, r in enumerate(found):
        low, high = F.col(f"below{i}") / F.col("n"), F.col(f"upto{i}") / F.col("n")
        off = F.greatest(low - r["p"], F.lit(r["p"]) - high, F.lit(0.0))
        out.append(F.struct(F.lit(r["p"]).alias("p"), F.col("n"), (off <= sketches.RANK_ERROR).alias("within_bound")))
    return ranks.select(F.inline(F.array(*out)))


@query(
    "sketch_distinct",
    with_(INC) + """SELECT CAST(year(incident_on) AS INTEGER) AS year, count(DISTINCT custkey) AS exact, true AS within_bound
    FROM inc GROUP BY 1""",
)
def sketch_distinct(spark, sf):
    """Distinct reporters per year from the sketches of its days, each held against the exact count."""
    held, rows = _sketched(spark, sf)
    told = sketches.distinct(held.withColumn("year", F.year("day")), "custkey", ["year"])
    exact = rows.groupBy(F.year("incident_on").alias("year")).agg(F.count_distinct("custkey").alias("exact"))
    off = F.abs(F.col("estimate") - F.col("exact"))
    return exact.join(told, "year").select("year", "exact", (off <= F.col("exact") * sketches.DISTINCT_ERROR).alias("within_bound"))


# --- checks by batch -----------------------------------------------------


@query("dq_incremental", SQL["dq_report"])
def dq_incremental(spark, sf):
    """The incident checks over three batches, the second one replayed; ids repeat inside batches and between them."""
    rows, rules, path = stable(_dq_table(spark, sf)), quality.incident_rules(DQ_AS_OF), scratch_path(spark, "checks")
    quality_state.start(rows, path, rules, buckets=8)
    for batch_id in (0, 1, 1, 2):
        quality_state.add(rows.where(F.pmod("event_id", F.lit(3)) == batch_id), path, rules, batch_id)
    return quality_state.report(spark, path).withColumn("fraction", F.round("fraction", 6))


# --- layouts -------------------------------------------------------------


def bucketed_lookup(spark, sf, buckets: int = 8):
    """Rain at incidents from a grid in buckets of (cell, day); samples and days are tables of their own."""
    grid, at = star.rain_grid(spark, sf), scratch_path(spark, "bucketed-grid")
    name = tables.write_bucketed_grid(grid, f"{at}/grid", buckets)
    tables.write_grid_days(spark.table(name), f"{at}/days")
    samples, days = stable(star.samples(spark, sf)), spark.read.schema("date date").parquet(f"{at}/days")
    return name, rain.at_points(samples, spark.table(name), star.GEOMETRY, "incident_date", "lon", "lat", 1, days)


@query("rain_window_points_bucketed", SQL["rain_window_points"])
def rain_window_points_bucketed(spark, sf):
    _, found = bucketed_lookup(spark, sf)
    return found.select("incident_id", day_text("incident_date").alias("incident_date"), *V.RAIN_ALL)


@query("json_loss_variant", SQL["json_loss_fields"])
def json_loss_variant(spark, sf):
    """Loss fields by paths of the report stored as VARIANT: the text is parsed once, when it is written."""
    records = star.with_raw(star.incidents(spark, sf)).select("id", "raw_data")
    stored = stable(landed.with_variant(records, "raw_data").drop("raw_data"))
    count = lambda f: F.coalesce(landed.from_variant(f"$.loss.{f}", "int"), F.lit(0))
    return stored.select(
        "id", landed.variant_id("loss").alias("loss_id"), landed.from_variant("$.loss.estimatedLoss", "double").alias("estimated_loss"),
        count("peopleDeathCount").alias("deaths"), count("peopleInjuredCount").alias("injured"),
    )


_TILE = "CAST(list_sum(list_transform(range(0, 12), lambda i: (({c} >> i) & 1) << (2 * i))) AS BIGINT)"


@query(
    "map_cluster_pyramid",
    with_(INC) + f""", drawn AS (
      SELECT id, lon, lat, floor((lon + 180) / 360 * 4096e0) AS x, floor((lat + 90) / 180 * 4096e0) AS y
      FROM inc WHERE id % 10 <> 9 AND lat <> 0 AND lon <> 0),
    tiles AS (SELECT z AS zoom, id, lon, lat, CAST(x AS BIGINT) >> (12 - z) AS x, CAST(y AS BIGINT) >> (12 - z) AS y
      FROM drawn, (SELECT CAST(unnest(range(0, 13)) AS INTEGER) AS z))
    SELECT zoom, {_TILE.format(c='x')} + 2 * {_TILE.format(c='y')} AS key, count(*) AS points, round(avg(lon), 6) AS center_lon,
      round(avg(lat), 6) AS center_lat, min(id) AS first_id FROM tiles GROUP BY zoom, x, y""",
)
def map_cluster_pyramid(spark, sf):
    """Marker clusters of the map for zooms 12 to 0, each level from the one before."""
    points = listing_points(spark, sf)
    found = pyramid.clusters(pyramid.pyramid(points))
    return found.withColumns({"center_lon": rounded("center_lon"), "center_lat": rounded("center_lat")})


def listing_points(spark, sf):
    from ..operators import listing

    return listing.drawable(_map(spark, sf)).select("id", "longitude", "latitude")


# --- streams -------------------------------------------------------------


@query(
    "stream_closed_months",
    with_(INC) + """, land AS (
      SELECT date_trunc('month', incident_on) AS month, hazard AS kind, price,
        CASE WHEN id % 10 = 0 THEN 3 WHEN incident_on < TIMESTAMP '1998-07-01' THEN 0 WHEN incident_on < TIMESTAMP '2000-01-01' THEN 1 ELSE 2 END AS batch
      FROM inc),
    ahead AS (SELECT l.*, (SELECT max(month) FROM land b WHERE b.batch < l.batch) AS newest FROM land l),
    told AS (SELECT *, coalesce(month <= newest - INTERVAL 40 DAY, false) AS late FROM ahead)
    SELECT strftime(month, '%Y-%m') AS month, kind, count(*) AS n, round(sum(price), 2) AS total,
      count(*) FILTER (late) AS late FROM told GROUP BY 1, 2""",
)
def stream_closed_months(spark, sf):
    """Reports in three landings by time and a fourth with a tenth of all periods: months close once, late rows are counted in."""
    rows = star.incidents(spark, sf).select("id", "incident_on", F.col("hazard_id"), "price").join(
        star.hazards(spark, sf).select(F.col("id").alias("hazard_id"), F.col("title").alias("hazard")), "hazard_id"
    )
    rows = stable(rows.select("id", "incident_on", "hazard", "price"))
    when = F.col("incident_on")
    batch = F.when(F.col("id") % 10 == 0, 3).when(when < "1998-07-01", 0).when(when < "2000-01-01", 1).otherwise(2)
    landing, out, first, second = (scratch_path(spark, n) for n in ("reports", "months", "progress", "closing"))
    for i in range(4):
        rows.where(batch == i).write.mode("append").parquet(landing)
        events = spark.readStream.schema(rows.schema).parquet(landing)
        closed.start_intake(events, out, first, "incident_on", "hazard", "price").awaitTermination()
        closed.start_closing(spark, out, second).awaitTermination()
    return closed.totals(spark, out).select(
        F.date_format("month", "yyyy-MM").alias("month"), "kind", "n", F.round("total", 2).alias("total"), "late"
    )
