"""Keyed writes as table-in, table-out joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def collapse(batch: DataFrame, keys: list[str], mutable: list[str], order: Column | str | None = None) -> DataFrame:
    """One row per key: mutable columns from the last row, the rest from the first.

    Structs keep NULLs, so a NULL in the last row is a value like any other, and a row
    whose `order` is NULL counts as the oldest. Rows that tie in `order` follow their arrival, the batch's
    `arrival` column if it has one; those that still tie go by their values, so that any run gives the same. With neither
    an order nor an arrival, a key with rows that differ stops the job: nothing says which is the last.
    Partial aggregation shrinks a hot key before the shuffle.
    """
    told = order is not None or "arrival" in batch.columns
    order = F.lit(0) if order is None else F.col(order) if isinstance(order, str) else order
    arrival = F.col("arrival") if "arrival" in batch.columns else F.lit(0)
    columns = [c for c in batch.columns if c != "arrival"]
    values = F.struct(*[c for c in columns if c not in keys])
    order = F.struct(order.isNotNull().alias("known"), order.alias("order"), arrival.alias("arrival"), values.alias("values"))
    batch = batch.withColumn("_order", order).drop("arrival")
    first = [c for c in columns if c not in keys and c not in mutable]
    aggregates = [F.max_by(F.struct(*mutable), "_order").alias("_last"), F.min("_order").alias("_a"), F.max("_order").alias("_b")]
    if first:
        aggregates.append(F.min_by(F.struct(*first), "_order").alias("_first"))
    folded = batch.groupBy(*keys).agg(*(aggregates if not told else [a for i, a in enumerate(aggregates) if i not in (1, 2)]))
    if not told:
        text = F.concat(F.lit(f"rows of a batch with the same {', '.join(keys)} differ, and there is no order or arrival: "), F.to_json(F.struct(*keys)))
        folded = folded.where(F.when(F.col("_a") == F.col("_b"), F.lit(True)).otherwise(F.raise_error(text).isNull()))
    return folded.select(
        *[
            F.col(c) if c in keys else F.col(f"_last.{c}") if c in mutable else F.col(f"_first.{c}")
            for c in columns
        ]
    )


def unkeyed(batch: DataFrame, keys: list[str]) -> DataFrame:
    """Batch rows that `upsert` leaves out, as a part of their key is NULL."""
    return batch.where(" or ".join(f"{k} is null" for k in keys))


def upsert(
    existing: DataFrame, batch: DataFrame, keys: list[str], mutable: list[str], order: Column | str | None = None
) -> DataFrame:
    """Insert unseen keys; for known keys overwrite only the mutable columns.

    A key that the batch repeats is collapsed first (see `collapse`), so the result holds a key once if the
    stored table does. Rows without a full key are left out; `unkeyed` returns them.

    The stored table stays on the streamed side of every join: with a daily-sized
    batch AQE broadcasts the batch keys and the stored table is not shuffled;
    with a bulk batch the same plan becomes a sort-merge join on the key.
    """
    columns = existing.columns
    extra = [c for c in (order, "arrival") if isinstance(c, str) and c in batch.columns and c not in columns]
    batch = batch.select(*columns, *extra).where(" and ".join(f"{k} is not null" for k in keys))
    batch = collapse(batch, keys, mutable, order).select(*columns)

    patch = batch.select(*keys, F.struct(*mutable).alias("_new"))
    updated = existing.join(patch, keys, "left").select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            if c in mutable
            else F.col(c)
            for c in columns
        ]
    )
    # Known keys are at most as many as the batch; only they meet the batch again.
    known = existing.select(*keys).join(batch.select(*keys), keys, "left_semi")
    return updated.unionByName(batch.join(known, keys, "left_anti").select(*columns))


def update_only(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Overwrite columns of matching rows; unmatched source rows are dropped.

    If the source repeats a key, the largest value tuple wins.
    """
    patch = source.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_new"))
    return target.join(patch, keys, "left").select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in target.columns
        ]
    )
