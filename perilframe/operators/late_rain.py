"""Late or corrected pixels: which sample keys they change, and the rain tables with only those recomputed.

A window [d - 7, d) is turned around: a pixel of day p lies in the windows of the days p + 1 to p + 7, so an explode and an
equi join find the keys that hold it. A day that had no image at all also opens the gate of every key in reach.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as V, schema
from ..session import stable
from ..sources import versions
from . import rain
from .rain import CELL, Geometry
from .upsert import collapse, update_only, upsert

PIXEL = [*CELL, "date"]


def newest_pixels(arrived: DataFrame, order: str = "landed_at") -> DataFrame:
    """One row per pixel of a landing: the value that landed last."""
    return collapse(arrived.select(*PIXEL, "precip_mm", order), PIXEL, ["precip_mm", order], order).drop(order)


def changed_pixels(grid: DataFrame, arrived: DataFrame) -> DataFrame:
    """Pixels of a landing (one row each) that the grid does not hold, or holds with another value.

    Only grid days between the first and the last landed day are read.
    """
    first, last = (arrived.agg(f("date")).scalar() for f in (F.min, F.max))
    held = grid.where(F.col("date").between(first, last)).select(*PIXEL, F.col("precip_mm").alias("_held"), F.lit(True).alias("_known"))
    found = arrived.join(held, PIXEL, "left")
    return found.where(F.col("_known").isNull() | ~F.col("precip_mm").eqNullSafe(F.col("_held"))).select(*PIXEL, "precip_mm")


def new_days(grid: DataFrame, arrived: DataFrame) -> DataFrame:
    """Landed days of which the grid has no pixel: distinct days, bounded by the calendar."""
    return arrived.select("date").distinct().join(grid.select("date").distinct(), "date", "left_anti")


def merged_grid(grid: DataFrame, arrived: DataFrame) -> DataFrame:
    return upsert(grid.select(*PIXEL, "precip_mm"), arrived, PIXEL, ["precip_mm"])


def _ahead(days: DataFrame, day: str, reach: int, *keep: str) -> DataFrame:
    back = F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_back")
    return days.select(*keep, "date", back).select(*keep, F.date_add("date", F.col("_back")).alias(day)).distinct()


def touched_keys(keys: DataFrame, changed: DataFrame, opened: DataFrame, day: str, gate: int) -> DataFrame:
    """Distinct (cell, day) keys whose 7-day window holds a changed pixel or whose gate window holds an opened day.

    `opened` days are broadcast by their size if at all; changed pixels meet the keys in an equi join.
    """
    by_pixel = keys.join(_ahead(changed, day, V.PEAK_WINDOW, *CELL), [*CELL, day], "left_semi")
    by_day = keys.join(_ahead(opened, day, gate), day, "left_semi")
    return by_pixel.unionByName(by_day).distinct()


@dataclass(frozen=True)
class Landing:
    """What a landing does to the grid: the new grid, the changed pixels, and the days that had no image before."""

    grid: DataFrame
    changed: DataFrame
    opened: DataFrame


def land(grid: DataFrame, arrived: DataFrame) -> Landing:
    """The landing upon a grid as it is read. The new grid is not written: a lookup reads the days it reaches, and patches them."""
    pixels = stable(newest_pixels(arrived))
    return Landing(merged_grid(grid, pixels), stable(changed_pixels(grid, pixels)), stable(new_days(grid, pixels)))


DAYS_OF_BUCKET = 32


def store_grid(grid: DataFrame, path: str) -> None:
    """The grid as a versioned table (`sources.versions`) in buckets of neighbouring days."""
    days = f"cast(floor(unix_date(`date`) / {DAYS_OF_BUCKET}) as bigint)"
    versions.create(grid.select(*PIXEL, "precip_mm"), path, PIXEL, days)


def land_stored(spark: SparkSession, path: str, arrived: DataFrame) -> Landing:
    """The landing upon a stored grid: only buckets with a landed day are read, and only those with a changed pixel are written.

    A bucket holds whole days, so it also tells which landed days had no image.
    """
    pixels = stable(newest_pixels(arrived))
    held = versions.read_buckets_of(spark, path, pixels.select(*PIXEL))
    changed, opened = stable(changed_pixels(held, pixels)), stable(new_days(held, pixels))
    versions.patch(spark, path, changed)
    return Landing(versions.read(spark, path), changed, opened)


def _touched_samples(samples: DataFrame, landing: Landing, geometry: Geometry, day: str, gate: int) -> tuple[DataFrame, DataFrame]:
    """(samples to look up again, their distinct keys)."""
    placed = samples.where(F.col(day).isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    located = placed.select("*", *geometry.cells("lon", "lat"))
    keys = stable(touched_keys(located.select(*CELL, day).distinct(), landing.changed, landing.opened, day, gate))
    return stable(located.join(keys, [*CELL, day], "left_semi").drop(*CELL)), keys


def refresh_incident_rain(
    stored: DataFrame, samples: DataFrame, landing: Landing, geometry: Geometry, fetched_at
) -> tuple[DataFrame, DataFrame]:
    """(rain per incident, touched keys): sums written by the table's own rule, then the peak where it is known.

    Samples carry incident_id, incident_date, lon, lat. An incident without a row gets one as soon as the day before has an
    image. The sums need an image on the day before, the peak one in seven days.
    """
    day = "incident_date"
    again, keys = _touched_samples(samples, landing, geometry, day, V.PEAK_WINDOW)
    sums = rain.at_points(again, landing.grid, geometry, day, "lon", "lat", gate=1)
    fresh = sums.select(
        "incident_id", day, *V.RAIN_SUMS, F.lit(None).cast("double").alias("rain_peak_7d"), F.lit(fetched_at).cast("timestamp").alias("fetched_at")
    )
    written = upsert(stored, fresh, *schema.UPSERT_RULES["incident_rain"])
    peaks = rain.at_points(again, landing.grid, geometry, day, "lon", "lat", gate=V.PEAK_WINDOW)
    peaks = peaks.where("rain_peak_7d is not null").select("incident_id", "rain_peak_7d")
    return update_only(written, peaks, ["incident_id"], ["rain_peak_7d"]), keys


def refresh_daily_rain(
    stored: DataFrame, points: DataFrame, target_days: DataFrame, landing: Landing, geometry: Geometry, ingested_at,
    group: str = "district_id",
) -> tuple[DataFrame, DataFrame]:
    """(rain per district and target day, touched keys): touched rows are written anew, those that lost a value go.

    Points are one row per district (`rain.centroids`).
    """
    day = "sample_date"
    days = target_days.agg(F.sort_array(F.collect_set(day))).scalar()  # calendar-bounded
    wanted = points.select(group, "lon", "lat", F.explode(days).alias(day))
    again, keys = _touched_samples(wanted, landing, geometry, day, V.PEAK_WINDOW)
    found = rain.at_points(again, landing.grid, geometry, day, "lon", "lat", gate=V.PEAK_WINDOW)
    fresh = stable(found.dropna(subset=V.RAIN_ALL).select(
        group, day, *[F.col(c).cast(stored.schema[c].dataType).alias(c) for c in V.RAIN_ALL], F.lit(ingested_at).cast("timestamp").alias("ingested_at")
    ))
    lost = again.select(group, day).join(fresh.select(group, day), [group, day], "left_anti")
    return upsert(stored.join(lost, [group, day], "left_anti"), fresh, *schema.UPSERT_RULES["district_daily_rain"]), keys
