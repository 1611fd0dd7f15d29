"""The panel kept up to date: a report changes its cell, the next period's lag and the means of its calendar month.

State is the panel with the first period's cells (`cells`), whose sums and counts per series and calendar month give the means.
A month changes a few cells; a period, district or hazard never seen before adds cells for all it meets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import month_index
from ..session import stable
from .grids import CELL, SERIES

FEATURES = [*CELL, "incident_count", "prev_month_count", "historical_month_avg"]


@dataclass(frozen=True)
class State:
    """cells: every grid cell with its features; months: total and n per (district, hazard, month)."""

    cells: DataFrame
    months: DataFrame


def build(grid: DataFrame) -> State:
    """The state of a whole grid (`grids.full_grid`)."""
    months = stable(_months(grid))
    return State(stable(_featured(grid, grid, months, _next_period(grid))), months)


def _months(grid: DataFrame) -> DataFrame:
    return grid.groupBy(*SERIES, "month").agg(F.sum("incident_count").alias("total"), F.count("*").alias("n"))


def _next_period(cells: DataFrame) -> DataFrame:
    """Each period but the last one and the period after it: a calendar-sized table from one sorted array."""
    seen = F.sort_array(F.collect_set(month_index("year", "month")))
    pairs = cells.agg(seen.alias("at")).select(F.inline(F.arrays_zip(F.col("at").alias("a"), F.expr("slice(at, 2, size(at))").alias("b"))))
    return pairs.toDF("_a", "_b").where("_b is not null")


def _year_month(index: str) -> list:
    return [F.floor(F.col(index) / 12).cast("int").alias("year"), (F.col(index) % 12 + 1).cast("int").alias("month")]


def _featured(cells: DataFrame, grid: DataFrame, months: DataFrame, following: DataFrame) -> DataFrame:
    """Cells (without features) with the features they have in the grid."""
    lag = grid.select(*SERIES, month_index("year", "month").alias("_a"), F.col("incident_count").alias("prev_month_count"))
    lag = lag.join(following, "_a").select(*SERIES, *_year_month("_b"), "prev_month_count")
    mean = months.select(*SERIES, "month", (F.col("total") / F.col("n")).alias("historical_month_avg"))
    return cells.select(*CELL, "incident_count").join(lag, CELL, "left").join(mean, [*SERIES, "month"]).select(*FEATURES)


def panel(state: State) -> DataFrame:
    """As `grids.panel_features`: cells that have a period before them."""
    return state.cells.where("prev_month_count is not null")


def deltas(counts: DataFrame) -> DataFrame:
    """Counts of the reports of a landing (`grids.monthly_counts`) as additions; negative ones take reports back."""
    return counts.select(*CELL, F.col("incident_count").alias("added"))


def refresh(state: State, added: DataFrame) -> tuple[State, DataFrame]:
    """(state after the additions, the cells whose row is new or changed). Same as `build` of the grid of all reports.

    `added` holds a row per cell. Cells are patched by keys; nothing but periods, districts and hazards, all of them
    dimension- or calendar-sized, is looked at as a whole.
    """
    added = stable(added.where("added <> 0"))
    cells = state.cells.select(*CELL, "incident_count")
    new = _new_cells(cells, added)
    # Cells with another count, all new ones included.
    counted = stable(
        cells.join(added, CELL).select(*CELL, (F.col("incident_count") + F.col("added")).alias("incident_count"))
        .unionByName(new.join(added, CELL, "left").select(*CELL, F.coalesce("added", F.lit(0)).cast("bigint").alias("incident_count")))
    )
    fresh = counted.join(new, CELL, "left_semi")
    change = added.groupBy(*SERIES, "month").agg(F.sum("added").alias("_total")).join(
        fresh.groupBy(*SERIES, "month").agg(F.count("*").alias("_n")), [*SERIES, "month"], "full"
    )
    months = stable(
        state.months.join(change, [*SERIES, "month"], "full").select(
            *SERIES, "month",
            (F.coalesce("total", F.lit(0)) + F.coalesce("_total", F.lit(0))).alias("total"),
            (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"),
        )
    )
    grid = stable(cells.join(counted, CELL, "left_anti").unionByName(counted))
    following = stable(_next_period(grid))
    after = counted.select(*SERIES, month_index("year", "month").alias("_a")).join(following, "_a").select(*SERIES, *_year_month("_b"))
    same_month = grid.select(*CELL).join(change.select(*SERIES, "month"), [*SERIES, "month"], "left_semi")
    touched = stable(counted.select(*CELL).unionByName(after.select(*CELL)).unionByName(same_month).distinct())
    # A touched cell needs its own count and that of the period before: only those counts are looked up.
    before = touched.select(*SERIES, month_index("year", "month").alias("_b")).join(following, "_b").select(*SERIES, *_year_month("_a"))
    needed = grid.join(touched.unionByName(before.select(*CELL)).distinct(), CELL, "left_semi")
    again = _featured(needed.join(touched, CELL, "left_semi"), needed, months, following)
    old = state.cells.select(*CELL, F.struct(*FEATURES[4:]).alias("_old"))
    joined = again.join(old, CELL, "left")
    changed = stable(joined.where(~F.col("_old").eqNullSafe(F.struct(*FEATURES[4:]))).select(*FEATURES))
    return State(stable(state.cells.join(changed, CELL, "left_anti").unionByName(changed)), months), changed


def _new_cells(cells: DataFrame, added: DataFrame) -> DataFrame:
    """Cells that the grid gets for a period, district or hazard it has not seen: rows explode by dimension-sized arrays."""
    both = cells.select(*CELL).unionByName(added.select(*CELL))
    hazards = both.agg(F.sort_array(F.collect_set("hazard"))).scalar()
    periods = both.agg(F.sort_array(F.collect_set(F.struct("year", "month")))).scalar()
    whole = (
        both.select("district").distinct().select("district", F.explode(hazards).alias("hazard"))
        .select("district", "hazard", F.explode(periods).alias("p")).select("district", "hazard", "p.year", "p.month")
    )
    return stable(whole.join(cells.select(*CELL), CELL, "left_anti"))
