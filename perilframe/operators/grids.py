"""Monthly counts, the dense district x hazard x period grid, and its features."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import month_index

SERIES = ["district", "hazard"]
CELL = ["district", "hazard", "year", "month"]


def monthly_counts(incidents: DataFrame, districts: DataFrame, hazards: DataFrame, titles=None) -> DataFrame:
    """Incidents per (district title, hazard title, year, month).

    The fact is counted by ids first, so the dimension joins see one row per cell
    and a hot district or month has already collapsed map-side. Equal titles merge.
    """
    by_id = (
        incidents.select(
            "district_id", "hazard_id", F.year("incident_on").alias("year"), F.month("incident_on").alias("month")
        )
        .where("district_id is not null and hazard_id is not null")
        .groupBy("district_id", "hazard_id", "year", "month")
        .agg(F.count("*").alias("n"))
    )
    hazards = hazards.select(F.col("id").alias("hazard_id"), F.col("title").alias("hazard"))
    if titles is not None:
        hazards = hazards.where(F.col("hazard").isin(list(titles)))
    districts = districts.select(F.col("id").alias("district_id"), F.col("title").alias("district"))
    return (
        by_id.join(districts, "district_id")
        .join(hazards, "hazard_id")
        .groupBy(*CELL)
        .agg(F.sum("n").alias("incident_count"))
    )


def full_grid(counts: DataFrame) -> DataFrame:
    """Every observed district x hazard x observed period, zero-filled.

    Hazards and periods are dimension- and calendar-sized; they travel as sorted arrays and are
    exploded per district, so the grid grows row-local from the district list.
    """
    hazards = counts.agg(F.sort_array(F.collect_set("hazard"))).scalar()
    periods = counts.agg(F.sort_array(F.collect_set(F.struct("year", "month")))).scalar()
    cells = (
        counts.select("district")
        .distinct()
        .select("district", F.explode(hazards).alias("hazard"))
        .select("district", "hazard", F.explode(periods).alias("p"))
        .select("district", "hazard", "p.year", "p.month")
    )
    return cells.join(counts, CELL, "left").select(
        *CELL, F.coalesce("incident_count", F.lit(0)).cast("bigint").alias("incident_count")
    )


def panel_features(grid: DataFrame, historical: str = "all") -> DataFrame:
    """Count of the previous observed period, and the mean count of the calendar month.

    historical="all": the mean covers the whole history, the row itself included.
    historical="expanding": only earlier years of that month; null for the first.
    The mean is taken before rows without a previous period are dropped.
    """
    series = Window.partitionBy(*SERIES).orderBy("year", "month")
    same_month = Window.partitionBy(*SERIES, "month")
    if historical == "expanding":
        same_month = same_month.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    elif historical != "all":
        raise ValueError("historical must be 'all' or 'expanding'")
    return (
        grid.withColumn("prev_month_count", F.lag("incident_count").over(series))
        .withColumn("historical_month_avg", F.avg("incident_count").over(same_month))
        .where("prev_month_count is not null")
    )


def serving_features(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """Features as used when serving, for all requested cells at once.

    The previous month is the calendar month before (0 without incidents). The mean
    covers only years with at least one incident, else 0.0.
    """
    previous = counts.select(
        *SERIES, (month_index("year", "month") + 1).alias("_at"), F.col("incident_count").alias("prev_month_count")
    )
    usual = counts.groupBy(*SERIES, "month").agg(F.avg("incident_count").alias("historical_month_avg"))
    return (
        requests.withColumn("_at", month_index("year", "month"))
        .join(previous, [*SERIES, "_at"], "left")
        .join(usual, [*SERIES, "month"], "left")
        .drop("_at")
        .withColumn("prev_month_count", F.coalesce("prev_month_count", F.lit(0)).cast("bigint"))
        .withColumn("historical_month_avg", F.coalesce("historical_month_avg", F.lit(0.0)))
    )


def in_periods(periods: DataFrame, when: str) -> Column:
    """Predicate on a time column that holds inside the given (year, month) periods.

    Neighbouring months merge into ranges with literal bounds, so the scan of the
    fact skips everything else. The months come back to the driver: a calendar-bounded list.
    """
    months = sorted(r["m"] for r in periods.select(month_index("year", "month").alias("m")).distinct().collect())
    inside = F.lit(False)
    while months:
        run = 1
        while run < len(months) and months[run] == months[0] + run:
            run += 1
        start, end = (dt.datetime(m // 12, m % 12 + 1, 1) for m in (months[0], months[0] + run))
        inside = inside | ((F.col(when) >= F.lit(start)) & (F.col(when) < F.lit(end)))
        months = months[run:]
    return inside


def refresh_periods(counts: DataFrame, recomputed: DataFrame, touched: DataFrame) -> DataFrame:
    """Replace the cells of the touched (year, month) periods by recomputed ones."""
    kept = counts.join(touched.select("year", "month").distinct(), ["year", "month"], "left_anti")
    return kept.select(*CELL, "incident_count").unionByName(recomputed.select(*CELL, "incident_count"))
