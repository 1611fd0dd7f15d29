"""Append-only log of model runs: parameters, settings and metrics as rows."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema


def entries(
    spark: SparkSession, name: str, params: dict, metrics: dict, run_id: str | None = None, start_time=None, model: str | None = None
) -> DataFrame:
    """One run as rows (a handful per run); `model` is the path of the saved pipeline."""
    run_id = run_id or uuid.uuid4().hex
    start_time = start_time or dt.datetime.now(dt.timezone.utc)
    rows = [(run_id, name, "param", k, str(v), start_time) for k, v in params.items()]
    rows += [(run_id, name, "metric", k, None if v is None else repr(float(v)), start_time) for k, v in metrics.items()]
    if model is not None:
        rows.append((run_id, name, "model", "path", model, start_time))
    return spark.createDataFrame(rows, schema.RUN_LOG)


def append(run: DataFrame, path: str) -> None:
    run.coalesce(1).write.mode("append").partitionBy("name").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.RUN_LOG).parquet(path)


def latest(log: DataFrame, name: str | None = None) -> DataFrame:
    """Per name: the run with the newest start (ties by run id)."""
    rows = log if name is None else log.where(F.col("name") == name)
    return rows.groupBy("name").agg(
        F.max_by("run_id", F.struct("start_time", "run_id")).alias("run_id"), F.max("start_time").alias("start_time")
    )


def record(spark: SparkSession, name: str, params: dict, metrics: dict, model, log_path: str, model_root: str) -> str:
    """Save the fitted pipeline, then log the run that points to it; returns the run id."""
    run_id = uuid.uuid4().hex
    path = f"{model_root}/{name}/{run_id}"
    model.write().save(path)
    append(entries(spark, name, params, metrics, run_id, model=path), log_path)
    return run_id


def load_latest(spark: SparkSession, name: str, log_path: str) -> PipelineModel:
    """The pipeline of the newest run of a name that saved one."""
    saved = read(spark, log_path).where((F.col("name") == name) & (F.col("kind") == "model"))
    row = saved.agg(F.max_by("value", F.struct("start_time", "run_id")).alias("path")).first()
    if row["path"] is None:
        raise LookupError(f"no trained model named {name}")
    return PipelineModel.load(row["path"])


def metrics_of(log: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, key, value of the given runs' metrics."""
    return (
        log.where("kind = 'metric'")
        .join(runs.select("run_id"), "run_id", "left_semi")
        .select("run_id", "key", F.col("value").cast("double").alias("value"))
    )


def lift(results: DataFrame, baseline: str, metric: str) -> DataFrame:
    """run, value, lift over the baseline run of one metric; results are (run, metric, value) rows."""
    rows = results.where(F.col("metric") == metric).select("run", "value")
    base = rows.where(F.col("run") == baseline).agg(F.max("value")).scalar()
    return rows.select("run", "value", (F.col("value") - base).alias("lift"))
