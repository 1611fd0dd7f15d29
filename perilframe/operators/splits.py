"""Train/test marks. Every split adds a column and leaves the rows in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.scalar import month_index, spread_hash
from ..session import stable
from .order_stats import first_rows, first_rows_of_each


MOST_LABELS = 100
END_OF_TIME = 253402300799999999  # the last microsecond of year 9999


def mark_last_periods(df: DataFrame, periods: int = V.TEST_PERIODS, year="year", month="month") -> DataFrame:
    """is_test = row lies in the last `periods` distinct (year, month) periods."""
    index = month_index(year, month)
    seen = F.sort_array(F.collect_set(index))  # calendar-bounded
    cut = df.agg(F.element_at(seen, -F.least(F.lit(periods), F.size(seen))).alias("cut")).scalar()
    return df.withColumn("is_test", index >= cut)


def mark_recent_dates(df: DataFrame, day: str, fraction: float = V.TEST_FRACTION) -> DataFrame:
    """is_test = row lies in the most recent share of distinct days (floor, at least one). Rows without a day train.

    `day` must be a date: distinct times are as many as rows.
    """
    if df.schema[day].dataType.typeName() != "date":
        raise TypeError(f"{day} is {df.schema[day].dataType.simpleString()}, not a date")
    seen = F.sort_array(F.collect_set(day))  # calendar-bounded
    take = F.greatest(F.lit(1), F.floor(F.size(seen) * F.lit(fraction)).cast("int"))
    cut = df.agg(F.element_at(seen, -take).alias("cut")).scalar()
    return df.withColumn("is_test", F.coalesce(F.col(day) >= cut, F.lit(False)))


def mark_recent_rows(df: DataFrame, when: str, row_id: str, fraction: float = V.TEST_FRACTION) -> DataFrame:
    """is_test = row is among the last floor(share) rows by (time, id), at least one.

    Rows without a time count as the most recent. The cut is located as a (time, id) pair by histogram passes; the mark itself
    is a comparison, even if one instant holds a third of the table.
    """
    time = F.coalesce(F.unix_micros(F.col(when).cast("timestamp")), F.lit(END_OF_TIME))
    keys = [time, F.col(row_id).cast("bigint")]
    train = first_rows(df, keys, lambda rows: rows - max(1, int(rows * fraction)))
    return df.withColumn("is_test", ~train)


def mark_stratified(
    df: DataFrame, label: str, row_id: str, labels=None, fraction: float = V.TEST_FRACTION, seed: int = V.SEED
) -> DataFrame:
    """is_test = the lowest-hash share of each label, with exact per-label quotas (nearest integer).

    Every label of the table is a stratum of its own, NULL too; with `labels`, only these, and the rest trains.
    """
    keys = [spread_hash(row_id, seed), F.col(row_id).cast("bigint")]
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"{label} has more than {MOST_LABELS} values")
    values = sorted(sizes, key=lambda v: (v is None, v)) if labels is None else list(labels)
    strata = [F.col(label).eqNullSafe(F.lit(v)) for v in values]
    quotas = [int(sizes.get(v, 0) * fraction + 0.5) for v in values]
    test: Column = F.lit(False)
    for stratum, first in zip(strata, first_rows_of_each(df, strata, keys, quotas)):
        test = test | (stratum & first)
    return df.withColumn("is_test", test)


def with_fold(df: DataFrame, row_id: str, folds: int = V.CV_FOLDS, seed: int = V.SEED) -> DataFrame:
    """Fold number from the id alone; the hash is independent of the label, so folds keep its balance."""
    return df.withColumn("fold", F.pmod(F.floor(spread_hash(row_id, seed + 1) / F.lit(65536)), F.lit(folds)).cast("int"))


def halves(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test); together they are all rows, as a row without a mark trains."""
    return (
        marked.where(~F.coalesce("is_test", F.lit(False))).drop("is_test"),
        marked.where("is_test").drop("is_test"),
    )


def negative_samples(
    positives: DataFrame, points: DataFrame, group: str, day: str, ratio: int = 2, seed: int = V.SEED,
    allow_fewer: bool = False,
) -> DataFrame:
    """Non-event days per group: `ratio` per positive, over the positives' date range.

    Candidates are every (group, day) of the range without a positive, at the group's point.
    The take is exact: the lowest hashes, ties by (group, day). Column `achieved_ratio` says how many negatives
    per positive there are. Where events are so dense that too few days are free, this raises, or with
    `allow_fewer` takes all of them.
    """
    span = positives.agg(F.min(day).alias("a"), F.max(day).alias("b"), F.count("*").alias("n")).first()
    if not span["n"]:
        return points.limit(0).withColumns({day: F.lit(None).cast("date"), "achieved_ratio": F.lit(None).cast("double")})
    days = F.sequence(F.lit(span["a"]), F.lit(span["b"]), F.expr("interval 1 day"))
    free = stable(
        points.select("*", F.explode(days).alias(day)).join(
            positives.select(group, day).distinct(), [group, day], "left_anti"
        )
    )
    number = F.col(group).cast("bigint") * 1_000_000 + F.unix_date(day)
    keys = [spread_hash(number, seed), number]
    wanted, taken = ratio * span["n"], 0

    def take(there: int) -> int:
        nonlocal taken
        if there < wanted and not allow_fewer:
            raise ValueError(f"{wanted} negatives asked for, {there} free ({group}, {day}) pairs; pass allow_fewer to take these")
        taken = min(wanted, there)
        return taken

    chosen = free.where(first_rows(free, keys, take))  # counts the free pairs on its way
    return chosen.withColumn("achieved_ratio", F.lit(taken / span["n"]))
