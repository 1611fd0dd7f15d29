"""Feature encodings. What is learned from train is dimension- or single-row-sized."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, Window, functions as F

from .order_stats import running_totals


def label_codes(df: DataFrame, column: str, large: bool = False) -> DataFrame:
    """value -> 0-based position in sorted order.

    The distinct values are numbered in one task, as they are a dimension; say `large` for a vocabulary
    that does not fit one, to number it by written ranges.
    """
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    if large:
        numbered = running_totals(values.withColumn("n", F.lit(1)), "value", ["n"])
        return numbered.select("value", F.col("n_before").cast("int").alias("code"))
    return values.select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias("code"))


MOST_VALUES = 10_000


def label_positions(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Per column the expression of its code (see `label_codes`), for dimensions of up to MOST_VALUES values: one pass finds all
    vocabularies, and the codes are literals, so no row is joined."""
    found = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns]).first()
    for c in columns:
        if len(found[c]) > MOST_VALUES:
            raise ValueError(f"{c} has more than {MOST_VALUES} values; use label_codes with large=True")
    return {c: (F.array_position(F.array(*[F.lit(v) for v in found[c]]), F.col(c)) - 1).cast("int") for c in columns}


def label_indexer(inputs: list[str], outputs: list[str]) -> StringIndexer:
    """Same codes as label_codes, as a pipeline stage; unknown values raise."""
    return StringIndexer(inputCols=inputs, outputCols=outputs, stringOrderType="alphabetAsc", handleInvalid="error")


def fit_one_hot(train: DataFrame, column: str) -> PipelineModel:
    """Train vocabulary in sorted order; unseen values and NULL become all zeros in `<column>_vec`."""
    text = f"{column}_text"
    return Pipeline(
        stages=[
            StringIndexer(
                inputCol=text, outputCol=f"{column}_code", stringOrderType="alphabetAsc", handleInvalid="keep"
            ),
            OneHotEncoder(inputCols=[f"{column}_code"], outputCols=[f"{column}_vec"], dropLast=True),
        ]
    ).fit(train.withColumn(text, F.col(column).cast("string")))


def apply_one_hot(model: PipelineModel, df: DataFrame, column: str) -> DataFrame:
    return model.transform(df.withColumn(f"{column}_text", F.col(column).cast("string"))).drop(f"{column}_text")


def fit_scale(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (one aggregated row)."""
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}


def apply_scale(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "_scaled") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})
