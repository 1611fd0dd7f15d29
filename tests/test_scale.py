"""Plan shapes that have to hold when the tables are large."""

import contextlib
import datetime as dt

import pytest
from pyspark.sql import functions as F

from perilframe import schema
from perilframe.operators import grids, rain, upsert as writes
from perilframe.session import shared_folder, stable
from perilframe.sources import landed


@contextlib.contextmanager
def settings(spark, **conf):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


BIG = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


def hot_samples(spark, n):
    """Every third sample at one place on one day."""
    day = F.when(F.col("id") % 3 == 0, F.lit(dt.date(2024, 1, 20))).otherwise(
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 28).cast("int"))
    )
    lon = F.when(F.col("id") % 3 == 0, F.lit(80.5)).otherwise(80.5 + (F.col("id") % 40).cast("double"))
    return spark.range(0, n, 1, 16).select("id", day.alias("d"), lon.alias("lon"), F.lit(26.5).alias("lat"))


def test_a_hot_place_is_split(spark):
    grid = spark.range(40).select(
        F.col("id").cast("int").alias("cell_x"), F.lit(0).alias("cell_y"),
        F.explode(F.sequence(F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 1, 31)))).alias("date"), F.lit(1.0).alias("precip_mm"),
    )
    with settings(spark, **BIG):
        df = rain.at_points(hot_samples(spark, 400_000), grid, rain.Geometry(80.0, 26.0, 1.0), "d", "lon", "lat", 7)
        rows = df.collect()
        assert "skew=true" in plan(df)
    hot = [r for r in rows if r["id"] % 3 == 0]
    assert len(hot) == 133_334 and all(r["rain_7d"] == 7.0 and r["rain_1d"] == 1.0 for r in hot[:1000])


def test_a_hot_batch_key_collapses_before_the_shuffle(spark):
    stored = spark.range(1000).selectExpr("id", "'old' as title", "0L as seq")
    batch = spark.range(0, 300_000, 1, 8).selectExpr("if(id % 3 = 0, 7L, id) as id", "cast(id as string) as title", "id as seq")
    with settings(spark, **BIG):
        done = writes.upsert(stored, batch, ["id"], ["title"], order="seq")
        assert done.where("id = 7").first()["title"] == "299997"
        assert "partial_max_by" in plan(done)


def test_counting_meets_the_dimensions_after_the_fact_is_counted(spark):
    at = dt.datetime(2024, 7, 1)
    inc = spark.range(1000).select((F.col("id") % 3).cast("int").alias("district_id"), F.lit(1).alias("hazard_id"), F.lit(at).alias("incident_on"))
    dim = spark.range(3).selectExpr("cast(id as int) as id", "concat('t', id) as title")
    text = plan(grids.monthly_counts(inc, dim, dim))
    assert text.rindex("partial_count") > text.rindex("Join")  # deeper in the tree than every join


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "incidents")
    at = dt.datetime(2024, 7, 1)
    row = (1, "a", None, 17, at, None, True, None, None, "drr_api", 82.6, 28.3, None, None, None, "{}")
    spark.createDataFrame([row], schema.INCIDENTS).write.parquet(path)
    inc = spark.read.schema(schema.INCIDENTS).parquet(path)
    text = plan(landed.trailing_window(inc, at + dt.timedelta(days=1), 3).select("id"))
    assert "LessThan(incident_on" in text and "GreaterThan(incident_on" in text and "EqualTo(data_source,drr_api)" in text
    assert "raw_data" not in text
    periods = spark.createDataFrame([(2024, 6), (2024, 7), (2025, 1)], "year int, month int")
    late = inc.where(grids.in_periods(periods, "incident_on"))
    assert late.count() == 1
    text = plan(late.select("id"))
    assert "GreaterThanOrEqual(incident_on,2024-06-01" in text and "LessThan(incident_on,2024-08-01" in text


def test_no_period_touched(spark):
    none = spark.createDataFrame([], "year int, month int")
    assert spark.range(3).withColumn("at", F.lit(dt.datetime(2024, 1, 1))).where(grids.in_periods(none, "at")).count() == 0


def test_only_reachable_grid_days_are_read(spark, tmp_path):
    path = str(tmp_path / "grid")
    days = F.sequence(F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 3, 31)))
    spark.range(4).select(
        F.col("id").cast("int").alias("cell_x"), F.lit(0).alias("cell_y"), F.lit(1.0).alias("precip_mm"), F.explode(days).alias("date")
    ).write.partitionBy("date").parquet(path)
    samples = spark.createDataFrame([(1, dt.date(2024, 2, 10), 80.5, 26.5)], "id int, d date, lon double, lat double")
    df = rain.at_points(samples, spark.read.parquet(path), rain.Geometry(80.0, 26.0, 1.0), "d", "lon", "lat", 7)
    assert df.first()["rain_7d"] == 7.0
    assert "PartitionFilters: [isnotnull(date" in plan(df) and "(date" in plan(df).split("PartitionFilters")[1][:400]


def test_stable_layout_depends_on_the_data_alone(spark):
    base = spark.range(5000).selectExpr("id", "id * 7 % 13 as v")
    order = lambda d: [r["id"] for r in d.collect()]
    assert order(stable(base, ["id"])) == order(stable(base.repartition(11), ["id"]))


def test_shared_folder_follows_the_setting(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named
    assert all(named in f for f in stable(spark.range(1)).inputFiles())


def test_centroids_do_not_sort_the_samples(spark):
    rows = [(3, "a", 1.5, None), (2, "a", 2.5, 3.5), (None, "a", 9.0, 9.0), (7, "b", None, 4.0), (8, "b", 1.0, 1.0), (None, "c", 1.0, 1.0)]
    samples = spark.createDataFrame(rows, "id bigint, place string, lon double, lat double")
    found = rain.centroids(samples, "place", "lon", "lat", "id")
    assert sorted(map(tuple, found.collect())) == [("a", 2.5, 3.5), ("b", None, 4.0), ("c", None, None)]
    assert "SortAggregate" not in plan(rain.centroids(samples, "id", "lon", "lat", "id"))
