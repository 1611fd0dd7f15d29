"""Readers and writers of stage tables. Schemas are always explicit: no inference pass."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV. Rows that do not fit the schema stop the read instead of turning into NULLs."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def read_rain_grid(spark: SparkSession, path: str, first_day, end_day) -> DataFrame:
    """Daily raster rows of [first_day, end_day); with a date-partitioned table only those days are read."""
    return spark.read.parquet(path).where((F.col("date") >= F.lit(first_day)) & (F.col("date") < F.lit(end_day)))


def write_rain_grid(grid: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per day. A day is spread over cells, so a dense day is not one task's work."""
    grid.repartition("date", F.pmod(F.hash("cell_x", "cell_y"), F.lit(8))).write.mode(mode).partitionBy("date").parquet(path)


def write_bucketed_grid(grid: DataFrame, path: str, buckets: int, name: str | None = None) -> str:
    """The grid as a table in buckets of (cell_x, cell_y, date), in the session's catalog; its name.

    A lookup of (cell, day) probes then sorts and moves its probes only: the grid is read in place, again and again.
    Partitions by year keep a lookup off the years that its samples cannot reach.
    """
    name = name or f"rain_grid_{uuid.uuid4().hex}"
    keys = ["cell_x", "cell_y", "date"]
    spread = grid.withColumn("year", F.year("date")).repartition(buckets, *keys)
    writer = spread.write.format("parquet").partitionBy("year").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path).saveAsTable(name)
    return name


def write_grid_days(grid: DataFrame, path: str) -> None:
    """The days that have an image: a calendar-sized table beside the grid (see `rain.at_points`)."""
    grid.select("date").distinct().coalesce(1).write.parquet(path)
