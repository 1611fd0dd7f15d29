"""Score requests: validation with a reason per rejected row, and feature lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V


def _missing(column: str):
    """Absent, empty, or zero."""
    text = F.trim(F.col(column).cast("string"))
    return text.isNull() | (text == "") | (text.try_cast("double") == 0)


def _known(rows: DataFrame, names: DataFrame, column: str, extra: dict | None = None) -> DataFrame:
    """Left join on a dimension title; `_<column>` tells whether it matched."""
    titles = names.groupBy(F.col("title").alias(column)).agg(
        F.lit(True).alias(f"_{column}"), *[F.min(src).alias(dst) for dst, src in (extra or {}).items()]
    )
    return rows.join(titles, column, "left")


def judge_count_requests(requests: DataFrame, districts: DataFrame, hazards: DataFrame) -> DataFrame:
    """Requests with integer year/month and a reason (null when acceptable).

    Checked in order: all four fields present, integers, known names. The month's range is not checked.
    """
    rows = _known(_known(requests, districts, "district"), hazards, "hazard")
    year, month = F.col("year").try_cast("int"), F.col("month").try_cast("int")
    missing = _missing("district") | _missing("hazard") | _missing("year") | _missing("month")
    reason = (
        F.when(missing, "missing field")
        .when(year.isNull() | month.isNull(), "year and month must be integers")
        .when(F.col("_district").isNull() | F.col("_hazard").isNull(), "unknown district or hazard")
    )
    return rows.withColumn("reason", reason).withColumns({"year": year, "month": month}).drop("_district", "_hazard")


def judge_hazard_requests(requests: DataFrame, districts: DataFrame, daily_rain: DataFrame) -> DataFrame:
    """Requests with district id, date, month, the precomputed rain row, and a reason (null when acceptable)."""
    rows = _known(requests, districts, "district", {"district_id": "id"})
    day = F.when(F.col("date").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.col("date").try_cast("date"))
    rain = daily_rain.select(
        "district_id", "sample_date", F.lit(True).alias("_rain"), *[F.col(c).cast("double").alias(c) for c in V.RAIN_ALL]
    )
    rows = rows.withColumn("sample_date", day).join(rain, ["district_id", "sample_date"], "left")
    reason = (
        F.when(_missing("district") | _missing("date"), "missing field")
        .when(F.col("sample_date").isNull(), "date must be YYYY-MM-DD")
        .when(F.col("_district").isNull(), "unknown district")
        .when(F.col("_rain").isNull(), "no rainfall data")
    )
    return rows.withColumns({"reason": reason, "month": F.month("sample_date")}).drop("_district", "_rain")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("reason is null").drop("reason")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where("reason is not null")
