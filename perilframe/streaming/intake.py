"""Incremental intake: landed JSON lines into an append-only change log, folded by key on read.

Each micro-batch writes one folder named by its batch id, replacing whatever an
interrupted attempt left there, so a replay changes nothing. The stored table is never
rewritten by a batch; `compact` folds what is committed when reads get long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators.upsert import collapse, upsert
from ..session import stable
from ..sources import landed, versions
from . import folded

KEYS, MUTABLE = schema.UPSERT_RULES["incidents"]
LOG_SCHEMA = f"{schema.INCIDENTS}, changed_at timestamp, batch_id bigint"


def _write_batch(log_path: str, reject_path: str | None):
    def write(batch: DataFrame, batch_id: int) -> None:
        judged = landed.with_reason(batch.withColumnRenamed("value", "record")).persist()
        good = landed.flatten(judged.where("reason is null"))
        # The order inside a batch: by modification time, then by text for equal times.
        changed = F.coalesce("modified_on", "created_on", F.lit("1970-01-01").cast("timestamp"))
        rows = good.withColumn("changed_at", changed)
        # Only reports whose key the batch repeats are shuffled: the others are their key's one row already.
        repeated = stable(rows.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1").select(*KEYS))
        folded = rows.join(repeated, KEYS, "left_anti").select(*rows.columns).unionByName(
            collapse(rows.join(repeated, KEYS, "left_semi").select(*rows.columns), KEYS, [*MUTABLE, "changed_at"], F.struct("changed_at", "raw_data"))
        )
        folded.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")
        if reject_path is not None:
            bad = judged.where("reason is not null").select("record", "reason")
            bad.write.mode("overwrite").parquet(f"{reject_path}/batch_id={batch_id}")
        judged.unpersist()

    return write


def start(
    spark: SparkSession, landing: str, log_path: str, progress: str, reject_path: str | None = None, files_per_batch: int = 1000
) -> StreamingQuery:
    """Take in everything landed since the last run, then stop. `progress` remembers what was read."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(landing)
    return (
        lines.writeStream.foreachBatch(_write_batch(log_path, reject_path))
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    """The newest base and the batches after it."""
    return folded.read(spark, log_path, LOG_SCHEMA)


def current(log: DataFrame, keep: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The table the log describes: first-seen values, with the newest batch's mutable columns.

    Every folder holds a key once, so the oldest (after compaction: the large one) is the
    stored table, and the later ones are an upsert into it that leaves it unshuffled. `keep` names log columns
    to carry along from the newest batch. With `columns` only these are read, joined and returned; as a folder holds a key once,
    the batch alone says which row is the newest.
    """
    oldest = log.agg(F.min("batch_id")).scalar()
    keep = keep or []
    if columns is not None:
        wanted = [c for c in log.columns if c in {*KEYS, *columns, *keep, "modified_on", "changed_at", "batch_id"}]
        mutable = [c for c in MUTABLE if c in wanted]
        return _latest(log.select(*wanted), oldest, mutable, keep).select(*columns)
    return _latest(log, oldest, MUTABLE, keep)


def _latest(log: DataFrame, oldest: int | None, mutable: list[str], keep: list[str]) -> DataFrame:
    rows = log.drop(*[c for c in ("changed_at",) if c not in keep])
    base = rows.where(F.col("batch_id") == oldest).drop("batch_id")
    return upsert(base, rows.where(F.col("batch_id") > oldest), KEYS, [*mutable, *keep], order="batch_id")


def compact(spark: SparkSession, log_path: str, progress: str) -> int:
    """Fold all batches that the stream has committed into a base; the number of the last one (see `folded`)."""
    return folded.fold(spark, log_path, progress, LOG_SCHEMA, lambda log: current(log, keep=["changed_at"]))


def start_store(
    spark: SparkSession, landing: str, store: str, progress: str, files_per_batch: int = 1000, stream: str = "intake"
) -> StreamingQuery:
    """As `start`, into a versioned table of incidents (`sources.versions`): a batch rewrites the buckets it touches.

    The version carries the batch's number, so a batch that was published but not committed is not written twice.
    """
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(landing)

    def write(batch: DataFrame, batch_id: int) -> None:
        judged = landed.with_reason(batch.withColumnRenamed("value", "record"))
        good = landed.flatten(judged.where("reason is null"))
        changed = F.coalesce("modified_on", "created_on", F.lit("1970-01-01").cast("timestamp"))
        versions.merge(spark, store, good, MUTABLE, F.struct(changed, F.col("raw_data")), stream, batch_id)

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
