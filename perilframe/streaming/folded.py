"""Logs of one folder per batch (`batch_id=N`), and bases (`_bases/upto=N`) that hold what the batches up to N add up to.

A base takes in only batches that the stream has committed, and a committed batch is never run again. A batch that was
written but not committed stays outside, so its replay replaces its own folder and no more. Readers take the newest
complete base and the batches after it; batch folders may stay or go, they are not read twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

_BATCH, _BASE = re.compile(r"batch_id=(\d+)"), re.compile(r"upto=(\d+)")


def _folder(spark: SparkSession, path: str):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _numbers(spark: SparkSession, path: str, pattern: re.Pattern) -> list[int]:
    return sorted(int(m.group(1)) for m in map(pattern.fullmatch, _names(spark, path)) if m)


def base(spark: SparkSession, out: str) -> int | None:
    """Number of the newest complete base."""
    found = _numbers(spark, f"{out}/_bases", _BASE)
    return max((n for n in found if "_SUCCESS" in _names(spark, f"{out}/_bases/upto={n}")), default=None)


def committed(spark: SparkSession, progress: str) -> int | None:
    """The newest batch that the stream has committed."""
    return max((int(n) for n in _names(spark, f"{progress}/commits") if n.isdigit()), default=None)


def read(spark: SparkSession, out: str, schema: str, upto: int | None = None) -> DataFrame:
    """Rows of the newest base, with its number as `batch_id`, and of the batches after it (up to a number, if given)."""
    fields = StructType.fromDDL(schema)
    plain = StructType([f for f in fields if f.name != "batch_id"])
    first = base(spark, out)
    numbers = [n for n in _numbers(spark, out, _BATCH) if (first is None or n > first) and (upto is None or n <= upto)]
    parts = [] if first is None else [spark.read.schema(plain).parquet(f"{out}/_bases/upto={first}").withColumn("batch_id", F.lit(first).cast("bigint"))]
    if numbers:
        folders = [f"{out}/batch_id={n}" for n in numbers]
        parts.append(spark.read.schema(fields).option("basePath", out).parquet(*folders))
    if not parts:
        return spark.createDataFrame([], fields)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.select(*fields.names)


def fold(spark: SparkSession, out: str, progress: str, schema: str, added: Callable[[DataFrame], DataFrame]) -> int:
    """Write the base of all committed batches; its number. `added` folds a log to rows of the log's schema without batch_id."""
    last = committed(spark, progress)
    if last is None:
        raise ValueError(f"nothing committed in {progress}")
    if base(spark, out) != last:
        names = [f.name for f in StructType.fromDDL(schema) if f.name != "batch_id"]
        added(read(spark, out, schema, last)).select(*names).write.mode("overwrite").parquet(f"{out}/_bases/upto={last}")
    return last


def drop_folded(spark: SparkSession, out: str) -> int:
    """Delete batch folders that the base before the newest one holds, and all older bases: readers of the newest
    two stay served. How many folders went."""
    bases = _numbers(spark, f"{out}/_bases", _BASE)
    if len(bases) < 2 or base(spark, out) != bases[-1]:
        return 0
    gone = [f"{out}/batch_id={n}" for n in _numbers(spark, out, _BATCH) if n <= bases[-2]] + [f"{out}/_bases/upto={n}" for n in bases[:-2]]
    for name in gone:
        fs, at = _folder(spark, name)
        fs.delete(at, True)
    return len(gone)
