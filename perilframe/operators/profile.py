"""Summary tables over feature sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V


def dataset_profile(df: DataFrame, label: str, group: str, value: str) -> DataFrame:
    """Rows, label balance, distinct groups, value range."""
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.avg(label).alias("positive_rate"),
        F.count_distinct(group).alias("groups"),
        F.min(value).alias("value_min"),
        F.max(value).alias("value_max"),
    )


def split_summary(marked: DataFrame, day: str, label: str, inputs: list[str], sure: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """One row per half of a marked table: rows, first and last day, positive rate, rows with a missing input.

    With `sure`, groups whose label is near certain, also how many rows of the half belong to them.
    """
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in inputs]) if len(inputs) > 1 else F.col(inputs[0]).isNull().cast("int")
    certain = F.lit(0)
    if sure is not None:
        marked = marked.join(sure.select(group, F.lit(1).alias("_sure")), group, "left")
        certain = F.coalesce("_sure", F.lit(0))
    half = F.when(F.coalesce("is_test", F.lit(False)), "test").otherwise("train")
    return marked.groupBy(half.alias("half")).agg(
        F.count("*").alias("rows"), F.to_date(F.min(day)).alias("first_day"), F.to_date(F.max(day)).alias("last_day"),
        F.avg(label).alias("positive_rate"), F.sum(missing).alias("missing_input"), F.sum(certain).alias("near_certain"),
    )


def rate_by(df: DataFrame, group: str, label: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(label).alias("rate"), F.count("*").alias("rows"))


def seasonal_swing(incidents_by_month: DataFrame) -> DataFrame:
    """Busiest over quietest calendar month per hazard, from monthly counts."""
    months = incidents_by_month.groupBy("hazard", "month").agg(F.sum("incident_count").alias("n"))
    return months.groupBy("hazard").agg(
        F.max("n").alias("busiest"), F.min("n").alias("quietest"), (F.max("n") / F.min("n")).alias("swing")
    )


def tautological(df: DataFrame, train: DataFrame, group: str, label: str, rate: float = V.TAUTOLOGY_RATE) -> DataFrame:
    """Groups whose label rate exceeds `rate` and which occur in train.

    The rate is over all rows of `df`; pass train there too for the leak-free form.
    """
    sure = rate_by(df, group, label).where(F.col("rate") > F.lit(rate)).select(group)
    return sure.join(train.select(group).distinct(), group, "left_semi")


def drop_groups(df: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    return df.join(groups, group, "left_anti")
