"""Quality checks batch by batch: counts per rule add up, uniqueness keeps how often each key was seen.

Two versioned tables (`sources.versions`) hold the state: `rules`, the running counts, and per unique rule `keys-<column>`, in buckets of
the key. A batch reads and writes only the buckets of its own keys. The counts are published first and carry the batch's number, so a
batch that dies between the two is finished by its replay, and one that is replayed whole changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stable
from ..sources import versions
from .quality import Rule, judged, totals

BUCKETS = 64
STREAM = "checks"


def _rules_path(path: str) -> str:
    return f"{path}/rules"


def _keys_path(path: str, rule: Rule) -> str:
    return f"{path}/keys-{rule.column}"


def start(batch: DataFrame, path: str, rules: list[Rule], buckets: int = BUCKETS) -> None:
    """Empty state for batches with the columns of `batch`."""
    spark = batch.sparkSession
    none = totals(batch.limit(0), rules)
    versions.create(none, _rules_path(path), ["rule"], versions.by_hash(["rule"], 1))
    for rule in _unique(rules):
        keys = batch.limit(0).select(F.col(rule.column).alias("key")).withColumn("n", F.lit(0).cast("bigint"))
        versions.create(spark.createDataFrame([], keys.schema), _keys_path(path, rule), ["key"], versions.by_hash(["key"], buckets))


def _unique(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.kind == "unique"]


def _repeated(n: Column) -> Column:
    """Rows that break uniqueness among n rows of a key."""
    return F.when(n > 1, n).otherwise(F.lit(0))


def add(batch: DataFrame, path: str, rules: list[Rule], batch_id: int) -> None:
    """Take a batch into the state; a batch number is taken once."""
    spark = batch.sparkSession
    seen = {}
    for rule in _unique(rules):
        counted = stable(batch.where(F.col(rule.column).isNotNull()).groupBy(F.col(rule.column).alias("key")).agg(F.count("*").alias("added")))
        held = versions.read_buckets_of(spark, _keys_path(path, rule), counted)
        seen[rule] = stable(
            counted.join(held, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("before"), (F.coalesce("n", F.lit(0)) + F.col("added")).alias("n"))
        )
    before = versions.manifest(spark, _rules_path(path)).batches.get(STREAM, -1)
    if before < batch_id:
        plain = [r for r in rules if r.kind != "unique"]
        parts = [totals(batch, plain)] if plain else []
        parts += [
            keys.agg(
                F.coalesce(F.sum(F.col("n") - F.col("before")), F.lit(0)).alias("evaluated"),
                F.coalesce(F.sum(_repeated(F.col("n")) - _repeated(F.col("before"))), F.lit(0)).alias("unexpected"),
            ).select(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), F.lit(r.mostly).alias("mostly"), "evaluated", "unexpected")
            for r, keys in seen.items()
        ]
        added = reduce(DataFrame.unionByName, parts)
        running = versions.read(spark, _rules_path(path)).unionByName(added)
        summed = running.groupBy("rule", "column", "mostly").agg(*[F.sum(c).alias(c) for c in ("evaluated", "unexpected")])
        versions.merge(spark, _rules_path(path), summed, ["evaluated", "unexpected"], stream=STREAM, batch_id=batch_id)
    for rule, keys in seen.items():
        versions.merge(spark, _keys_path(path, rule), keys.select("key", "n"), ["n"], stream=STREAM, batch_id=batch_id)


def report(spark: SparkSession, path: str) -> DataFrame:
    """As `quality.report` over all batches taken in; a few rows are read, whatever the tables hold."""
    return judged(versions.read(spark, _rules_path(path)))
