"""Streaming queries, run to completion over everything landed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import star
from ..session import scratch_path
from ..streaming import counts, intake
from .base import INC, day_text, query, time_text, with_


@query(
    "stream_upsert",
    with_(INC) + """SELECT id, CASE WHEN status = 'O' THEN title ELSE 'revised ' || id END AS title, hazard_id, verified,
      strftime(reported_on + CASE WHEN status = 'O' THEN INTERVAL 1 DAY ELSE INTERVAL 5 DAY END, '%Y-%m-%d %H:%M:%S') AS modified_on
    FROM inc""",
)
def stream_upsert(spark, sf):
    """All reports land, then every F and P report lands again revised; the second run reads only the new files."""
    rows = star.incidents(spark, sf)
    landing, log, progress = (scratch_path(spark, n) for n in ("landing", "log", "progress"))
    star.raw_records(rows).select("record").write.text(landing, compression="gzip")
    intake.start(spark, landing, log, progress).awaitTermination()
    revised = F.concat(F.lit("revised "), F.col("id").cast("string"))
    again = star.raw_records(
        rows.where("status <> 'O'").withColumn("hazard_id", F.lit(40)), title=revised, modified="interval 5 days"
    )
    again.select("record").write.mode("append").text(landing, compression="gzip")
    intake.start(spark, landing, log, progress).awaitTermination()
    found = intake.current(intake.read_log(spark, log), columns=["id", "title", "hazard_id", "verified", "modified_on"])
    return found.withColumn("modified_on", time_text("modified_on"))


@query(
    "stream_counts",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total
    FROM events GROUP BY 1, 2""",
)
def stream_counts(spark, sf):
    """The later half of the events lands first, the earlier half with the second run."""
    table = star.table(spark, sf, "events")
    landing, out, progress = (scratch_path(spark, n) for n in ("events", "counts", "progress"))
    middle = table.agg(F.expr("percentile_approx(ts, 0.5)")).scalar()
    for half in (F.col("ts") >= middle, F.col("ts") < middle):
        table.where(half).write.mode("append").parquet(landing)
        events = spark.readStream.schema(table.schema).parquet(landing)
        counts.start_daily(events, out, progress, "ts", "event_type", "value").awaitTermination()
    return counts.latest(spark, out).select(
        day_text("day").alias("day"), "kind", "n", F.round("total", 4).alias("total")
    )
