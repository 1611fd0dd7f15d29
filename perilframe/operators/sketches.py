"""Mergeable summaries per day: quantile (KLL) and distinct (HLL) sketches that add up over days, batches and late rows.

A sketch of a day is a few kilobytes whatever the day holds. Any span of days is answered by merging its sketches, a late
landing by merging its own into the days it touches; the rows are not read again.

Stated errors: a quantile's rank is off by at most RANK_ERROR of the rows, a distinct count by at most DISTINCT_ERROR of itself. Both
are several times the sketches' own 99 % bounds at the sizes below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stable

KLL_SIZE, RANK_ERROR = 1000, 0.02
HLL_BITS, DISTINCT_ERROR = 14, 0.04


def _quantile_column(name: str) -> str:
    return f"kll_{name}"


def _distinct_column(name: str) -> str:
    return f"hll_{name}"


def daily(df: DataFrame, day: str, values: list[str], keys: list[str]) -> DataFrame:
    """One row per day: day, n, a quantile sketch per value column and a distinct sketch per key column. Nulls don't count.

    Tasks build partial sketches, so a day with a third of all rows costs no more than its rows.
    """
    made = [F.kll_sketch_agg_double(F.col(v).cast("double"), F.lit(KLL_SIZE)).alias(_quantile_column(v)) for v in values]
    made += [F.hll_sketch_agg(k, F.lit(HLL_BITS)).alias(_distinct_column(k)) for k in keys]
    return df.groupBy(day).agg(F.count("*").alias("n"), *made)


def _merge(column: str) -> Column:
    merged = F.kll_merge_agg_double(column) if column.startswith("kll_") else F.hll_union_agg(column)
    return merged.alias(column)


def merged(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sketches of a group of rows (all rows, without `by`) as one row each."""
    columns = [c for c in sketches.columns if c.startswith(("kll_", "hll_"))]
    grouped = sketches.groupBy(*by) if by else sketches
    return grouped.agg(F.sum("n").alias("n"), *[_merge(c) for c in columns])


def added(stored: DataFrame, fresh: DataFrame, day: str) -> DataFrame:
    """Stored sketches with those of a landing merged in; days the landing does not touch are passed through."""
    fresh = stable(fresh)
    untouched = stored.join(fresh.select(day), day, "left_anti")
    touched = stored.join(fresh.select(day), day, "left_semi").unionByName(fresh)
    return untouched.unionByName(merged(touched, [day]).select(*stored.columns))


def quantiles(sketches: DataFrame, value: str, probabilities: list[float]) -> DataFrame:
    """p, value: estimated quantiles over all days of `sketches`."""
    one = merged(sketches)
    pairs = [
        F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double(_quantile_column(value), F.lit(float(p))).alias("value"))
        for p in probabilities
    ]
    return one.select(F.inline(F.array(*pairs)))


def distinct(sketches: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Estimated distinct keys over all days, or per group of days."""
    return merged(sketches, by).select(*(by or []), F.hll_sketch_estimate(_distinct_column(key)).alias("estimate"))
