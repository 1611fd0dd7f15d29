"""Session settings, and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys: AQE splits the oversized partitions of a sort-merge or
    # shuffled-hash join, also when that costs one more exchange downstream.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "perilframe", **conf: str) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cores)
    )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by spark.checkpoint.dir.

    Only a local-mode session may fall back to a folder on this machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="perilframe-"))
    return sc.getCheckpointDir()


_OWNERS: list[list[str]] = []


@contextmanager
def owned_scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what `stable` and `scratch_path` made inside, for jobs whose results do not read it."""
    made: list[str] = []
    _OWNERS.append(made)
    try:
        yield
    finally:
        _OWNERS.remove(made)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in made:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].append(path)
    return path


def stable(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Write df to a table in the shared folder and read it from there.

    For results that several branches or an iterative fit read again: the
    inputs are scanned once, a lost executor costs a re-read instead of a recompute,
    and the planner knows the true size of what it reads. With `order` (columns that identify a row) the
    layout depends on the data alone, so seeded row sampling repeats from run to run.
    """
    if order is not None:
        df = df.repartition(*order).sortWithinPartitions(*order)
    path = scratch_path(df.sparkSession, "stable")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
