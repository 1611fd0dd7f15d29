"""Running event counts per day and kind, as a log of what each batch adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from . import folded

COUNTS = "day timestamp, kind string, n bigint, total double, batch_id bigint"


def start_daily(
    events: DataFrame, out: str, progress: str, when: str, kind: str, value: str
) -> StreamingQuery:
    """Sums per (day, kind) of every batch, in a folder named by the batch id; a replay replaces its own folder.

    Sums add up, so no state is kept and no watermark is needed: a row counts however late it comes. `latest` adds
    the batches, `compact` folds them when they get many.
    """
    rows = events.select(
        F.date_trunc("day", F.col(when).cast("timestamp")).alias("day"), F.col(kind).alias("kind"), F.col(value).alias("value")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        added = batch.groupBy("day", "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        added.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def read_log(spark: SparkSession, out: str) -> DataFrame:
    """The newest base and the batches after it."""
    return folded.read(spark, out, COUNTS)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The count and total of every (day, kind) over all batches."""
    return _added(read_log(spark, out))


def _added(log: DataFrame) -> DataFrame:
    return log.groupBy("day", "kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def compact(spark: SparkSession, out: str, progress: str) -> int:
    """Fold all batches that the stream has committed into a base; the number of the last one (see `folded`)."""
    return folded.fold(spark, out, progress, COUNTS, _added)
