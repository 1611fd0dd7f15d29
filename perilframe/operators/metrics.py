"""Exact model metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .order_stats import running_totals


def _score_table(scored: DataFrame, label: str, score: str, by: tuple[str, ...]) -> DataFrame:
    """Positives and negatives per distinct score: a score shared by a third of the rows is one row here."""
    return (
        scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )


def ranking_metrics(
    scored: DataFrame, label: str = "label", score: str = "score", by: tuple[str, ...] = (), ranges: int | None = None
) -> DataFrame:
    """roc_auc (ties count half) and average_precision (step sum), per `by` group or as one row.

    Null without both classes.
    """
    table = running_totals(_score_table(scored, label, score, by), "score", ["pos", "neg"], by, ranges)
    # Rows at or above a score are what a threshold there would flag.
    hits = F.col("pos_total") - F.col("pos_before")
    flagged = hits + F.col("neg_total") - F.col("neg_before")
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    both = (p > 0) & (n > 0)
    return table.groupBy(*by).agg(
        F.when(both, F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)) / (p * n)).alias("roc_auc"),
        F.when(both, F.sum(F.col("pos") * hits / flagged) / p).alias("average_precision"),
    )


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(scored, label, score).select("roc_auc")


def average_precision(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(scored, label, score).select("average_precision")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def prf_from_counts(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; each 0 when undefined."""
    return [
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def prf_at(scored: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score") -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of `score >= threshold`."""
    flagged, truth = F.col(score) >= F.lit(threshold), F.col(label) == 1
    return scored.agg(
        F.count_if(flagged & truth).alias("tp"),
        F.count_if(flagged & ~truth).alias("fp"),
        F.count_if(~flagged & truth).alias("fn"),
    ).select("tp", "fp", "fn", *prf_from_counts(F.col("tp"), F.col("fp"), F.col("fn")))


def classification_metrics(scored: DataFrame, label: str = "label", score: str = "score") -> dict[str, float]:
    """The five headline numbers of a binary model, as Python floats (two one-row results)."""
    ranked = ranking_metrics(scored, label, score).first()
    flat = prf_at(scored, 0.5, label, score).first()
    return {
        "roc_auc": ranked["roc_auc"],
        "pr_auc": ranked["average_precision"],
        "precision": flat["precision"],
        "recall": flat["recall"],
        "f1": flat["f1"],
    }


def regression_metrics(scored: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: n, mae, rmse, r2."""
    error = F.col(actual) - F.col(predicted)
    return scored.agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error * error).alias("_mse"),
        F.var_pop(actual).alias("_var"),
    ).select("n", "mae", "rmse", F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var")).alias("r2"))


def back_transformed_mae(scored: DataFrame, actual: str, predicted_log: str) -> DataFrame:
    return scored.agg(F.avg(F.abs(F.col(actual) - F.expm1(predicted_log))).alias("mae_real"))


def multiclass_metrics(scored: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy and macro F1 (unweighted over classes seen on either side)."""
    pairs = scored.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("cls"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("said"),
                         F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("said"),
                         F.lit(0).cast("bigint").alias("hit")),
            )
        )
    )
    per_class = sides.groupBy("cls").agg(F.sum("actual").alias("actual"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    f1 = F.when(F.col("actual") + F.col("said") > 0, 2 * F.col("hit") / (F.col("actual") + F.col("said"))).otherwise(F.lit(0.0))
    return per_class.agg(
        (F.sum("hit") / F.sum("actual")).alias("accuracy"),
        F.avg(f1).alias("f1_macro"),
    )


def majority_baseline(df: DataFrame, label: str = "label") -> DataFrame:
    """Always answering 0: its F1, and the share of rows it gets right."""
    return df.agg(
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count("*").alias("rows"),
    ).select(F.lit(0.0).alias("f1"), (1 - F.col("positives") / F.col("rows")).alias("accuracy"))
