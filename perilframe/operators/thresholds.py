"""Single-feature threshold rules, searched without multiplying the rows by the candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from .metrics import prf_from_counts, ranking_metrics
from .order_stats import quantiles_many


def candidates(df: DataFrame, features: list[str], percents=tuple(V.THRESHOLD_PERCENTS)) -> dict[str, list[float]]:
    """Percentiles per feature; the features share the passes."""
    return dict(zip(features, quantiles_many(df, list(features), [p / 100 for p in percents])))


def _reached(value: Column, cuts: list[float]) -> Column:
    """How many ascending cuts the value reaches."""
    return reduce(lambda a, b: a + b, [(value >= F.lit(c)).cast("int") for c in cuts])


def score_candidates(df: DataFrame, features: dict[str, list[float]], label: str = "label") -> DataFrame:
    """feature, position, threshold, tp, fp, fn, f1 for every candidate.

    One pass: each row falls between two neighbouring cuts, so per feature there are at most
    len(cuts) + 1 groups; counts at a cut are suffix sums over those groups.
    """
    reached = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), _reached(F.col(f), sorted(cuts)).alias("slot"))
            for f, cuts in features.items()
        ]
    )
    slots = (
        df.select(F.col(label).alias("label"), F.inline(reached))
        .where("slot is not null")
        .groupBy("feature", "slot")
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    )
    cuts = df.sparkSession.createDataFrame(
        [(f, i + 1, float(c)) for f, values in features.items() for i, c in enumerate(sorted(values))],
        "feature string, position int, threshold double",
    )
    everything = cuts.select("feature", F.col("position").alias("slot"), "threshold").unionByName(
        cuts.select("feature", F.lit(0).alias("slot"), F.lit(None).cast("double").alias("threshold")).distinct()
    )
    # At most (cuts + 1) rows per feature.
    downwards = Window.partitionBy("feature").orderBy(F.desc("slot"))
    whole = Window.partitionBy("feature")
    zero = F.lit(0)
    return (
        everything.join(slots, ["feature", "slot"], "left")
        .select(
            "feature",
            F.col("slot").alias("position"),
            "threshold",
            F.sum(F.coalesce("pos", zero)).over(downwards).alias("tp"),
            F.sum(F.coalesce("neg", zero)).over(downwards).alias("fp"),
            F.sum(F.coalesce("pos", zero)).over(whole).alias("p"),
        )
        .where("threshold is not null")
        .withColumn("fn", F.col("p") - F.col("tp"))
        .select("feature", "position", "threshold", "tp", "fp", "fn", prf_from_counts(F.col("tp"), F.col("fp"), F.col("fn"))[2])
    )


def best(scored: DataFrame) -> DataFrame:
    """Highest F1 per feature; among equals the first candidate."""
    return scored.groupBy("feature").agg(
        F.max_by("threshold", F.struct("f1", -F.col("position"))).alias("threshold"),
        F.max("f1").alias("train_f1"),
    )


def search(train: DataFrame, test: DataFrame, features=tuple(V.RAIN_SUMS), label: str = "label") -> DataFrame:
    """Pick each feature's threshold on train, score it once on test."""
    picked = best(score_candidates(train, candidates(train, list(features)), label)).collect()  # a row per feature
    pairs = F.array(
        *[
            F.struct(
                F.lit(r["feature"]).alias("feature"), F.lit(r["threshold"]).alias("threshold"),
                F.lit(r["train_f1"]).alias("train_f1"), F.col(r["feature"]).cast("double").alias("score"),
            )
            for r in picked
        ]
    )
    scored = test.select(F.col(label).alias("label"), F.inline(pairs))
    flagged, truth = F.col("score") >= F.col("threshold"), F.col("label") == 1
    flat = scored.groupBy("feature", "threshold", "train_f1").agg(
        F.count_if(flagged & truth).alias("tp"), F.count_if(flagged & ~truth).alias("fp"), F.count_if(~flagged & truth).alias("fn")
    )
    return flat.select(
        "feature", "threshold", "train_f1", *prf_from_counts(F.col("tp"), F.col("fp"), F.col("fn"))
    ).join(ranking_metrics(scored, by=("feature",)), "feature")
