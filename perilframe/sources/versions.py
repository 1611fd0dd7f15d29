"""A keyed table on plain files in versions: buckets of rows, and per version a manifest that names each bucket's folder.

A write puts the buckets it touches into a new folder and then publishes the next manifest by one rename. Until then
readers see the version before, and so they do if the write dies. Nothing is changed in place; a bucket that a write does
not touch is neither read nor written. A batch of a stream is published with its number, so a replay finds it there.

Buckets are by a hash of the key, or by the value of an integer column or expression where changes come in runs (periods, id
ranges). Choose so many that a bucket is one task's work.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from py4j.protocol import Py4JJavaError

from ..operators.upsert import collapse, upsert
from ..session import stable

BUCKET = "_bucket"
_NAME = re.compile(r"(\d+)\.json$")


class Conflict(RuntimeError):
    """Another writer has published the version this write was to be."""


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str  # JSON of the table's schema
    keys: list[str]
    bucket: str  # SQL expression of the bucket's number
    folders: dict[str, str]  # bucket -> folder of the write that holds it
    batches: dict[str, int] = field(default_factory=dict)  # stream -> newest batch in this version

    @property
    def fields(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


def by_hash(keys: list[str], buckets: int) -> str:
    return f"pmod(xxhash64({', '.join(f'`{k}`' for k in keys)}), {int(buckets)})"


def by_range(column: str, width: int) -> str:
    """Runs of `width` neighbouring values, for numbers that grow over time."""
    return f"cast(floor(`{column}` / {int(width)}) as bigint)"


class _Files:
    """The few file operations that are no Spark jobs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of last change in ms) of what a folder holds."""
        if not self.fs.exists(self.path(folder)):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(self.path(folder))]

    def publish(self, name: str, text: str) -> None:
        """Write a file under a name that must be new."""
        aside = f"{name.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
        out = self.fs.create(self.path(aside), False)
        out.write(bytearray(text.encode()))
        out.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.NONE
        target = self.fs.makeQualified(self.path(name))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(self.path(aside)), target, options)
        except (Py4JJavaError, CapturedException) as failed:
            self.fs.delete(self.path(aside), False)
            if self.fs.exists(target):
                raise Conflict(f"{name} is there already") from failed
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    found = (_NAME.fullmatch(n) for n, _ in _Files(spark, path).names(f"{path}/manifests"))
    return sorted(int(m.group(1)) for m in found if m)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """A version's manifest, the newest by default."""
    if version is None:
        there = versions(spark, path)
        if not there:
            raise FileNotFoundError(f"no table in {path}")
        version = there[-1]
    return Manifest(**json.loads(spark.read.text(f"{path}/manifests/{version:010}.json", wholetext=True).first()[0]))


def _rows(spark: SparkSession, path: str, of: Manifest, buckets: list[str] | None = None) -> DataFrame:
    wanted = of.folders if buckets is None else {b: of.folders[b] for b in buckets if b in of.folders}
    if not wanted:
        return spark.createDataFrame([], of.fields)
    folders = [f"{path}/data/{w}/{BUCKET}={b}" for b, w in sorted(wanted.items())]
    return spark.read.schema(of.fields).parquet(*folders)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows of one version; what is published later does not show."""
    return _rows(spark, path, manifest(spark, path, version))


def _publish(spark: SparkSession, path: str, new: Manifest) -> int:
    _Files(spark, path).publish(f"{path}/manifests/{new.version:010}.json", json.dumps(new.__dict__))
    return new.version


def _write(rows: DataFrame, path: str, bucket: str) -> dict[str, str]:
    """Write rows by bucket into a new folder; the buckets that have rows."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.withColumn(BUCKET, F.expr(bucket)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/data/{name}")
    made = [n for n, _ in _Files(spark, path).names(f"{path}/data/{name}")]
    return {n.split("=", 1)[1]: name for n in made if n.startswith(f"{BUCKET}=")}


def create(rows: DataFrame, path: str, keys: list[str], bucket: str) -> int:
    """The first version: rows hold each key once, without nulls in it."""
    if versions(rows.sparkSession, path):
        raise Conflict(f"{path} holds a table already")
    first = Manifest(0, rows.schema.json(), keys, bucket, _write(rows, path, bucket))
    return _publish(rows.sparkSession, path, first)


def _touched(rows: DataFrame, bucket: str) -> list[str]:
    """Numbers of the buckets that rows fall into: at most as many as the table has and the batch adds."""
    return sorted({str(r[0]) for r in rows.select(F.expr(bucket)).distinct().collect()})


def _next(spark: SparkSession, path: str, now: Manifest, rows: DataFrame, buckets: list[str], batches: dict[str, int]) -> int:
    made = _write(rows, path, now.bucket)
    folders = {b: w for b, w in now.folders.items() if b not in set(buckets)} | made
    return _publish(spark, path, replace(now, version=now.version + 1, folders=folders, batches={**now.batches, **batches}))


def merge(
    spark: SparkSession, path: str, batch: DataFrame, mutable: list[str], order: Column | str | None = None,
    stream: str | None = None, batch_id: int | None = None,
) -> int:
    """Upsert a batch (see `operators.upsert`) into the newest version; the version that holds it.

    Only buckets with a key of the batch are read and written. With `stream` and `batch_id`, a batch
    that a version holds already changes nothing. A batch without rows makes no version but its number's.
    """
    now = manifest(spark, path)
    if stream is not None and now.batches.get(stream, -1) >= batch_id:
        return now.version
    kept = [f.name for f in now.fields]
    extra = [c for c in (order, "arrival") if isinstance(c, str) and c in batch.columns and c not in kept]
    known = batch.select(*kept, *extra).where(" and ".join(f"`{k}` is not null" for k in now.keys))
    rows = stable(collapse(known, now.keys, mutable, order).select(*kept))
    touched = _touched(rows, now.bucket)
    batches = {} if stream is None else {stream: batch_id}
    if not touched:
        return _publish(spark, path, replace(now, version=now.version + 1, batches={**now.batches, **batches})) if batches else now.version
    done = upsert(_rows(spark, path, now, touched), rows, now.keys, mutable)
    return _next(spark, path, now, done, touched, batches)


def patch(spark: SparkSession, path: str, rows: DataFrame, gone: DataFrame | None = None) -> int:
    """Put rows in place of those with the same key, add new ones, take out the keys in `gone`; the new version.

    Each key stands once in rows. Only buckets of these keys are read and written.
    """
    now = manifest(spark, path)
    rows = stable(rows.select(*[f.name for f in now.fields]))
    keys = rows.select(*now.keys)
    if gone is not None:
        keys = keys.unionByName(gone.select(*now.keys))
    touched = _touched(keys, now.bucket)
    if not touched:
        return now.version
    left = _rows(spark, path, now, touched).join(keys, now.keys, "left_anti")
    return _next(spark, path, now, left.unionByName(rows), touched, {})


def read_buckets_of(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The rows of the buckets that `keys` fall into: all rows that can have one of these keys."""
    now = manifest(spark, path)
    return _rows(spark, path, now, _touched(keys, now.bucket))


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than_s: float = 86_400) -> int:
    """Delete manifests but the newest `keep`, and folders that none of those names and no writer can still be filling."""
    files, there = _Files(spark, path), versions(spark, path)
    used = {w for v in there[-keep:] for w in manifest(spark, path, v).folders.values()}
    for v in there[:-keep]:
        files.delete(f"{path}/manifests/{v:010}.json")
    old = [n for n, at in files.names(f"{path}/data") if n not in used and at < (time.time() - older_than_s) * 1000]
    for n in old:
        files.delete(f"{path}/data/{n}")
    return len(old)
