"""List, map and legend tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V, schema
from .order_stats import Ask, locate_many


def incident_list(incidents: DataFrame, hazards: DataFrame, page: int | None = 1, size: int = V.PAGE_SIZE) -> DataFrame:
    """Newest first, unknown times ahead of all, ties by id; the hazard nested (null if unknown).

    With a page number: that page, cut by a distributed top-k before the hazard join. Without: every row.
    """
    order = [F.desc_nulls_first("incident_on"), F.asc("id")]
    rows = incidents.select(*schema.LIST_FIELDS)
    if page is not None:
        rows = rows.orderBy(*order).offset(size * (page - 1)).limit(size)
    nested = hazards.select(F.col("id").alias("hazard_id"), F.struct(*schema.HAZARD_FIELDS).alias("hazard"))
    return (
        rows.join(nested, "hazard_id", "left")
        .select(
            "id", "title", "title_ne", "hazard", "incident_on", "reported_on", "verified", "approved",
            F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        )
        .orderBy(*order)
    )


UNDATED = -(1 << 62)  # sorts ahead of any time, newest first


def positions(incidents: DataFrame, places: list[int]) -> list[tuple]:
    """(incident_on, id) of the rows at the given places of the list, counted from 1, to go on from by `incidents_after`.

    The rows are located by histogram passes, which return a bounded number of rows however deep a place is; a top-k would
    send all rows ahead of a place to the driver.
    """
    newest = F.coalesce(-F.unix_micros(F.col("incident_on").cast("timestamp")), F.lit(UNDATED))
    number = F.col("id").cast("bigint")
    times = locate_many(incidents, [Ask(newest, [p - 1 for p in places])])[0]
    ids = locate_many(incidents, [Ask(number, [p - 1 - t.below], newest == F.lit(t.value)) for p, t in zip(places, times)])
    at = [(t.value, i.value) for t, (i,) in zip(times, ids)]
    here = reduce(or_, [(newest == F.lit(t)) & (number == F.lit(i)) for t, i in at])
    found = incidents.where(here).select(newest.alias("t"), "incident_on", "id").distinct().collect()  # one row per place
    rows = {(r["t"], r["id"]): (r["incident_on"], r["id"]) for r in found}
    return [rows[k] for k in at]


def incidents_after(incidents: DataFrame, hazards: DataFrame, incident_on, row_id, size: int = V.PAGE_SIZE) -> DataFrame:
    """The page of the list that follows a (time, id) position: a filter, so deep pages cost as little as early ones.

    Unknown times stand ahead of all, so after a position without a time come the other such rows, then any dated one.
    """
    if incident_on is None:
        later = F.col("incident_on").isNotNull() | (F.col("id") > F.lit(row_id))
    else:
        later = (F.col("incident_on") < F.lit(incident_on)) | (
            (F.col("incident_on") == F.lit(incident_on)) & (F.col("id") > F.lit(row_id))
        )
    return incident_list(incidents.where(later), hazards, page=1, size=size)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def hazard_list(hazards: DataFrame) -> DataFrame:
    return hazards.select(*schema.HAZARD_FIELDS).orderBy("title", "id")


def district_list(districts: DataFrame) -> DataFrame:
    return districts.select("id", "title").orderBy("title", "id")


def incident_map(incidents: DataFrame, hazards: DataFrame) -> DataFrame:
    """Every located incident with the title and colour of its hazard."""
    looks = hazards.select(
        F.col("id").alias("hazard_id"), F.col("title").alias("hazard_title"), F.col("color").alias("hazard_color")
    )
    return (
        incidents.where("lat is not null and lon is not null")
        .select("id", "hazard_id", "incident_on", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
        .join(looks, "hazard_id", "left")
        .select("id", "latitude", "longitude", "hazard_title", "hazard_color", "incident_on")
    )


def drawable(points: DataFrame) -> DataFrame:
    """Points the map draws: a coordinate of 0 counts as missing."""
    return points.where("latitude <> 0 and longitude <> 0")


def map_legend(points: DataFrame) -> DataFrame:
    """The colour each hazard title shows first, by id."""
    named = points.where("hazard_title <> '' and hazard_color <> ''")
    return named.groupBy("hazard_title").agg(
        F.min_by("hazard_color", "id").alias("hazard_color"), F.min("id").alias("first_id")
    )


def grid_density(points: DataFrame, step: float) -> DataFrame:
    """Points per square of `step` degrees, with their mean position."""
    return (
        points.groupBy(
            F.floor(F.col("longitude") / F.lit(step)).cast("int").alias("bin_x"),
            F.floor(F.col("latitude") / F.lit(step)).cast("int").alias("bin_y"),
        )
        .agg(F.count("*").alias("points"), F.avg("longitude").alias("center_lon"), F.avg("latitude").alias("center_lat"))
    )
