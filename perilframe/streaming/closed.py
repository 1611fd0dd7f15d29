"""Months that close once, and rows that come too late for theirs.

The intake cuts every batch into month sums and parts them by the newest month that earlier batches brought: a month further back than
the delay is closed, its rows are diverted. The others go on to a stateful query with the same delay as its watermark, which
emits a month when it closes and forgets it. That watermark is never ahead of the intake's, so nothing is dropped unseen:
closed months, months still open and diverted rows add up to all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

DELAY_DAYS = 40
SUMS = "month timestamp, kind string, n bigint, total double"


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _there(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def _has_file(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at) and any(s.getPath().getName().startswith("part-") for s in fs.listStatus(at))


def start_intake(
    events: DataFrame, out: str, progress: str, when: str, kind: str, value: str, delay_days: int = DELAY_DAYS
) -> StreamingQuery:
    """Month sums of each batch: `on_time` and `late` folders per batch id, and in `newest` the newest month so far.

    A replayed batch reads the `newest` of the batch before it and replaces its own folders, but for an on-time file that is
    there already: the next query may have taken it in, and the same rows under another file name would count twice.
    """
    rows = events.select(
        F.date_trunc("month", F.col(when).cast("timestamp")).alias("month"), F.col(kind).alias("kind"), F.col(value).alias("value")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sums = batch.where("month is not null").groupBy("month", "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")).persist()
        before = spark.read.schema("month timestamp").parquet(f"{out}/newest/batch_id={batch_id - 1}").first() if batch_id else None
        newest = before["month"] if before else None
        closed = F.lit(False) if newest is None else F.col("month") <= F.lit(newest) - F.make_dt_interval(days=F.lit(delay_days))
        sums.where(closed).write.mode("overwrite").parquet(f"{out}/late/batch_id={batch_id}")
        # One file a batch, there as a whole or not at all: the next query reads whole batches in order.
        if not _has_file(spark, f"{out}/on_time/batch_id={batch_id}"):
            sums.where(~closed).coalesce(1).write.mode("overwrite").parquet(f"{out}/on_time/batch_id={batch_id}")
        told = sums.agg(F.greatest(F.max("month"), F.lit(newest).cast("timestamp")).alias("month"))
        told.coalesce(1).write.mode("overwrite").parquet(f"{out}/newest/batch_id={batch_id}")
        sums.unpersist()

    return (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    )


def start_closing(spark: SparkSession, out: str, progress: str, delay_days: int = DELAY_DAYS) -> StreamingQuery:
    """Emit each (month, kind) once, when the newest month is more than the delay ahead; into `closed` folders per batch id."""
    sums = spark.readStream.schema(SUMS).parquet(f"{out}/on_time/batch_id=*")
    months = (
        sums.withWatermark("month", f"{delay_days} days").groupBy("month", "kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/closed/batch_id={batch_id}")

    return (
        months.writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )


def read(spark: SparkSession, out: str, part: str) -> DataFrame:
    """`closed`, `on_time` or `late` sums: month, kind, n, total, batch_id."""
    if not _there(spark, f"{out}/{part}"):
        return spark.createDataFrame([], f"{SUMS}, batch_id bigint")
    return spark.read.schema(f"{SUMS}, batch_id bigint").parquet(f"{out}/{part}")


def totals(spark: SparkSession, out: str) -> DataFrame:
    """month, kind, n, total, closed, late: what was emitted or is still open, with the rows that came too late counted in.

    `late` says how many of the n came after their month had closed.
    """
    closed, late = read(spark, out, "closed").drop("batch_id"), read(spark, out, "late")
    waiting = read(spark, out, "on_time").join(closed.select("month", "kind"), ["month", "kind"], "left_anti")
    zero = F.lit(0).cast("bigint")
    parts = closed.select("*", F.lit(True).alias("closed"), zero.alias("late"))
    parts = parts.unionByName(waiting.select("month", "kind", "n", "total", F.lit(False).alias("closed"), zero.alias("late")))
    parts = parts.unionByName(late.select("month", "kind", "n", "total", F.lit(True).alias("closed"), F.col("n").alias("late")))
    return parts.groupBy("month", "kind").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.bool_or("closed").alias("closed"), F.sum("late").alias("late")
    )
