"""Trailing rainfall windows [d - N, d): the day itself is never included."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V

CELL = ["cell_x", "cell_y"]


@dataclass(frozen=True)
class Geometry:
    """Raster origin and pixel size in degrees."""

    lon0: float
    lat0: float
    size: float

    def cells(self, lon: str, lat: str) -> list[Column]:
        """Integer cell numbers; coordinates are never join keys."""
        return [
            F.floor((F.col(lon) - self.lon0) / self.size).cast("int").alias("cell_x"),
            F.floor((F.col(lat) - self.lat0) / self.size).cast("int").alias("cell_y"),
        ]


def panel_windows(panel: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Window features for every row of a daily panel (one row per key and day).

    A key holds at most one row per calendar day, so no window partition can outgrow
    the calendar. All frames share one sort.
    """
    base = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day)))
    sums = [F.sum(value).over(base.rangeBetween(-n, -1)).alias(f"rain_{n}d") for n in V.RAIN_WINDOWS]
    peak = F.max(value).over(base.rangeBetween(-V.PEAK_WINDOW, -1)).alias(f"rain_peak_{V.PEAK_WINDOW}d")
    return panel.select(*keys, day, *sums, peak)


def coverage(days: DataFrame, grid: DataFrame, day: str) -> DataFrame:
    """Per distinct day: how many grid days fall in its 1-, 3- and 7-day windows.

    Both sides are distinct days, so the work is bounded by the calendar.
    """
    images = grid.select(F.col("date").alias("image")).distinct()
    reached = images.select(
        F.explode(F.sequence(F.lit(1), F.lit(V.PEAK_WINDOW))).alias("back"), "image"
    ).select(F.date_add("image", F.col("back")).alias(day), "back")
    counts = reached.groupBy(day).agg(
        *[F.count_if(F.col("back") <= n).alias(f"images_{n}d") for n in V.RAIN_WINDOWS]
    )
    return (
        days.select(day)
        .distinct()
        .join(counts, day, "left")
        .select(day, *[F.coalesce(f"images_{n}d", F.lit(0)).alias(f"images_{n}d") for n in V.RAIN_WINDOWS])
    )


def covered(samples: DataFrame, grid: DataFrame, day: str, window: int) -> DataFrame:
    """Keep samples whose window holds at least one grid day."""
    images = grid.select(F.col("date").alias("image")).distinct()
    reached = images.select("image", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("back"))
    days = reached.select(F.date_add("image", F.col("back")).alias(day)).distinct()
    return samples.join(days, day, "left_semi")


def at_points(
    samples: DataFrame, grid: DataFrame, geometry: Geometry, day: str, lon: str, lat: str, gate: int = 1,
    images: DataFrame | None = None,
) -> DataFrame:
    """Samples with rain_1d/3d/7d/peak of the pixel they fall in.

    Samples whose `gate`-day window has no grid day are dropped; samples over a
    missing pixel stay with NULLs. Samples first collapse to distinct (cell, day) keys,
    so thousands of reports from one place cost one lookup, and the range
    join becomes an equi join on (cell, day). One look at the samples gives the grid days they can reach; only those are
    read, of a grid that is partitioned by year only such years. `images`, the grid's days as a table of their own, spares the gate a look at the grid.
    """
    samples = samples.where(F.col(day).isNotNull() & F.col(lon).isNotNull() & F.col(lat).isNotNull())
    first, last = samples.agg(F.date_sub(F.min(day), V.PEAK_WINDOW), F.max(day)).first()
    inside = (F.col("date") >= F.lit(first).cast("date")) & (F.col("date") < F.lit(last).cast("date"))
    images = (grid if images is None else images).where(inside)
    if "year" in grid.columns and first is not None:
        inside = inside & F.col("year").between(first.year, last.year)
    grid = grid.where(inside)
    located = samples.select("*", *geometry.cells(lon, lat))
    keys = covered(located.select(*CELL, day).distinct(), images, day, gate)
    return located.join(key_windows(keys, grid, day), [*CELL, day]).drop(*CELL)


def key_windows(keys: DataFrame, grid: DataFrame, day: str) -> DataFrame:
    """Window features per distinct (cell, day) key; NULL where no pixel has a value."""
    probes = keys.select(
        *CELL, day, F.explode(F.sequence(F.lit(1), F.lit(V.PEAK_WINDOW))).alias("back")
    ).withColumn("date", F.date_sub(day, F.col("back")))
    hits = probes.join(grid.select(*CELL, "date", "precip_mm"), [*CELL, "date"], "left")
    return hits.groupBy(*CELL, day).agg(
        *[
            F.sum(F.when(F.col("back") <= n, F.col("precip_mm"))).alias(f"rain_{n}d")
            for n in V.RAIN_WINDOWS
        ],
        F.max("precip_mm").alias(f"rain_peak_{V.PEAK_WINDOW}d"),
    )


def centroids(samples: DataFrame, group: str, lon: str, lat: str, order: str) -> DataFrame:
    """One (lon, lat) per group: that of its smallest order key.

    Both see the same rows in the same order, so they come from one row; plain numbers are aggregated by hash, a struct would sort the samples.
    """
    return samples.groupBy(group).agg(F.min_by(lon, order).alias(lon), F.min_by(lat, order).alias(lat))


def daily_rain(points: DataFrame, grid: DataFrame, geometry: Geometry, target_days: DataFrame, group: str) -> DataFrame:
    """Window features of every group's point for every target day.

    Points are one row per group and target days are calendar days; the days travel as
    one sorted array. A day needs one grid day in its 7-day window, and a row needs all four values.
    """
    days = target_days.agg(F.sort_array(F.collect_set("sample_date"))).scalar()
    wanted = points.select(group, "lon", "lat", F.explode(days).alias("sample_date"))
    rain = at_points(wanted, grid, geometry, "sample_date", "lon", "lat", gate=V.PEAK_WINDOW)
    return rain.dropna(subset=V.RAIN_ALL).select(group, "sample_date", *V.RAIN_ALL)
