"""Model runs on Spark ML: fit on the train half, measure on the held-out half.

Inputs arrive as marked feature tables (column is_test). Every run returns plain
(run, metric, value) rows plus the fitted model, so results log and compare alike.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, OneVsRest, OneVsRestModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..functions import scalar as S
from ..operators import encode, metrics, order_stats, profile, splits
from ..session import shared_folder, stable

RESULT = "run string, metric string, value double"


@dataclass
class Run:
    name: str
    model: object
    features: list[str]
    values: dict[str, float]

    def rows(self) -> list[tuple[str, str, float | None]]:
        return [(self.name, k, None if v is None else float(v)) for k, v in self.values.items()]


def result_table(spark: SparkSession, runs: list[Run]) -> DataFrame:
    return spark.createDataFrame([r for run in runs for r in run.rows()], RESULT)


def importance_table(spark: SparkSession, run: Run) -> DataFrame:
    """Features by falling importance."""
    last = run.model.stages[-1] if isinstance(run.model, PipelineModel) else run.model
    trees = last.models if isinstance(last, OneVsRestModel) else [last]  # one against the rest: the mean of its models
    mean = lambda i: sum(float(t.featureImportances[i]) for t in trees) / len(trees)
    rows = [(run.name, f, mean(i)) for i, f in enumerate(run.features)]
    return spark.createDataFrame(rows, "run string, feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def with_rain(df: DataFrame) -> tuple[DataFrame, int]:
    """(rows with all four rain values, how many rows lack one). Trees take no NULL, and a missing pixel is no dry day."""
    missing = df.agg(F.count_if(F.greatest(*[F.col(c).isNull() for c in V.RAIN_ALL]))).first()[0]
    return df.dropna(subset=V.RAIN_ALL), missing


def _vector(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def _laid_out(marked: DataFrame, order: list[str]) -> DataFrame:
    """A marked table as the fits read it, given one whose mark is a comparison over written rows.

    The rows of a small train half are drawn as they lie, so they are written by `order`; a large one is folded, whatever its layout.
    """
    return stable(marked, order) if splits.halves(marked)[0].count() <= 2 * FEW_ROWS else marked


def _halves(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both halves of a marked table that is written once; the fit reads it many times."""
    shared_folder(marked.sparkSession)  # boosting checkpoints its running residuals there
    return splits.halves(marked)


# A train half of up to twice FEW_ROWS rows is fitted as it is. Of a larger one, equal rows are folded into some FEW_ROWS rows with a weight, or into
# LEAST_PARTS a combination as long as these are no more than twice FEW_ROWS.
FEW_ROWS, LEAST_PARTS = 500_000, 8


def folded(
    train: DataFrame, features: list[str], label: str, row_id: str, params: dict, averaged: bool = False
) -> tuple[DataFrame, dict]:
    """(train half, tree settings) for the same trees from fewer rows, where rows with equal features and label are many.

    Rain is known per pixel and day and the other features are codes, so a large half has far more rows than combinations. Such rows
    follow the same path in every tree and have the same gradient: one row that weighs as much gives the same splits and leaves, and the fewest
    rows of a leaf become the least weight. As boosting draws rows at random, a combination is cut into parts of about equal weight, of which each
    round draws some: common ones into many, rare ones stay whole, so that no draw moves more than a sliver of the half, and the fit has no
    more rows than twice FEW_ROWS and the combinations. Without drawing it is one part. With `averaged` (squared error) only the features need
    be equal: the label is then their mean, as what labels vary inside it is the same for every split; rows without one stay apart. A half
    with less than two rows a combination stays as it is.
    """
    rows = train.count()
    least = params.get("minInstancesPerNode", 1)
    if rows <= max(2 * FEW_ROWS, 2 * least):
        return train, params
    same = features if averaged else [*features, label]
    # Summed as decimals, so that the mean does not depend on the order in which partial sums arrive.
    n, total = F.count("*").alias("n"), F.sum(F.col(label).cast("decimal(20,15)")).cast("double")
    apart, mean = ([F.col(label).isNull().alias("missing")], [(total / F.count(label)).alias(label)]) if averaged else ([], [])
    sizes = stable(train.groupBy(*same, *apart).agg(*mean, n))
    combinations = sizes.count()
    if 2 * combinations > rows:
        return train, params
    wanted = max(FEW_ROWS, min(LEAST_PARTS * combinations, 2 * FEW_ROWS, rows // 2))
    parts = F.lit(1) if params.get("subsamplingRate", 1.0) == 1.0 else F.greatest(F.lit(1), F.floor(F.col("n") * wanted / rows).cast("int"))
    cut = sizes.withColumn("parts", parts).select("*", F.explode(F.sequence(F.lit(1), "parts")).alias("part"))
    share = F.floor(F.col("n") / F.col("parts")) + (F.col("part") <= F.pmod("n", "parts")).cast("int")  # whole rows, n in all
    weighed = cut.withColumn("weight", share.cast("double")).drop("n", "parts")
    settings = {**params, "weightCol": "weight", "minInstancesPerNode": 1}
    if least > 1:  # weights are whole numbers: half a row less excludes no leaf of `least` rows by rounding
        settings["minWeightFractionPerNode"] = (least - 0.5) / rows
    order = [*same, *(["missing"] if averaged else []), "part"]
    return stable(weighed, order).drop("part", "missing"), settings


def _fitted_rows(
    train: DataFrame, features: list[str], label: str, row_id: str, params: dict, averaged: bool = False
) -> tuple[DataFrame, dict]:
    """`folded`; a large half that does not fold is laid out by row, so that its draws repeat from run to run."""
    few, settings = folded(train, features, label, row_id, params, averaged)
    if settings is params and train.count() > 2 * FEW_ROWS:
        few = stable(train, [row_id, label])
    return few, settings


def _predicted(model, rows: DataFrame, features: list[str], once: bool) -> DataFrame:
    """Rows with their prediction; with `once`, every combination of features passes the trees once and its rows join it."""
    if not once:
        return model.transform(rows)
    scored = model.transform(rows.select(*features).distinct())
    return rows.join(stable(scored.select(*features, *[c for c in ("probability", "prediction") if c in scored.columns])), features)


def _together(fits: list[Callable[[], Run]]) -> list[Run]:
    """Independent fits side by side: a round of boosting is many short jobs, which leave cores idle."""
    with ThreadPoolExecutor(len(fits)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(fit)) for fit in fits]]


def classify(name, train, test, features, label, params, seed=V.SEED, row_id: str | None = None) -> Run:
    """Boosted trees with all features tried at each split. With `row_id`, equal rows of a large train half are folded."""
    settings = params
    if row_id is not None:
        train, settings = _fitted_rows(train, features, label, row_id, params)
    trees = GBTClassifier(labelCol=label, featuresCol="features", featureSubsetStrategy="all", seed=seed, **settings)
    model = Pipeline(stages=[_vector(features), trees]).fit(train)
    predicted = _predicted(model, test, features, once=settings is not params)
    return Run(name, model, features, metrics.classification_metrics(stable(_scored(predicted, label))))


def _scored(predicted: DataFrame, label: str) -> DataFrame:
    return predicted.select(
        F.col(label).cast("int").alias("label"), vector_to_array("probability")[1].alias("score")
    )


# --- monthly counts ------------------------------------------------------


def fit_counts(panel: DataFrame, params=None, seed=V.SEED) -> tuple[Run, DataFrame]:
    """Random forest on the panel; returns the run and the scored test periods."""
    params = params or V.RF_COUNTS
    cell = F.concat_ws("|", "district", "hazard", "year", "month").alias("cell")
    marked = stable(splits.mark_last_periods(panel).select("*", cell), ["cell"]).drop("cell")
    # Names are encoded over the whole panel, so held-out periods cannot bring unknown codes.
    codes = encode.label_indexer(["district", "hazard"], ["district_code", "hazard_code"]).fit(marked)
    # The sum drops the category metadata: trees then split the codes as plain numbers.
    plain = SQLTransformer(
        statement="SELECT *, district_code + 0 AS district_encoded, hazard_code + 0 AS hazard_encoded FROM __THIS__"
    )
    forest = RandomForestRegressor(
        labelCol="incident_count", featuresCol="features", featureSubsetStrategy="all", seed=seed, **params
    )
    train, test = _halves(marked)
    model = Pipeline(stages=[codes, plain, _vector(V.PANEL_FEATURES), forest]).fit(train)
    scored = stable(model.transform(test).select(*panel.columns, "prediction"))
    errors = metrics.regression_metrics(
        scored.select(F.col("incident_count").alias("actual"), S.clipped("prediction").alias("predicted"))
    ).first()
    return Run("monthly_counts", model, V.PANEL_FEATURES, {k: errors[k] for k in ("mae", "rmse", "r2")}), scored


def score_counts(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Batch scores: never negative, two digits, with the risk band."""
    scored = model.transform(features)
    out = scored.withColumn("predicted_incident_count", S.clip_round("prediction"))
    return out.select(
        "district", "hazard", "year", "month", "predicted_incident_count", "prev_month_count",
        F.bround("historical_month_avg", 2).alias("historical_month_avg"),
        S.count_band("predicted_incident_count").alias("risk"),
    )


# --- lead-lag ------------------------------------------------------------


def fit_leadlag(training: DataFrame, params=None) -> Run:
    """Boosting on rain, month and district; the most recent share of days is held out."""
    train, test = _halves(_laid_out(splits.mark_recent_dates(stable(training), "sample_date"), ["row_id", "label"]))
    return classify("leadlag", train, test, V.LEADLAG_FEATURES, "label", params or V.GBT_LEADLAG, row_id="row_id")


def fit_default_boosting(training: DataFrame, params=None) -> Run:
    """Untuned boosting on the stratified random split."""
    train, test = _halves(_laid_out(splits.mark_stratified(stable(training), "label", "row_id"), ["row_id", "label"]))
    return classify("gbt_default", train, test, V.LEADLAG_FEATURES, "label", params or V.GBT_DEFAULT, row_id="row_id")


def score_hazard(model: PipelineModel, requests: DataFrame) -> DataFrame:
    """Batch probabilities with three digits and the risk band."""
    scored = model.transform(requests)
    p = vector_to_array("probability")[1]
    return scored.select(
        "district", "sample_date", F.bround(p, 3).alias("risk_probability"),
        *[F.bround(c, 2).alias(c) for c in V.RAIN_ALL], S.probability_band(p).alias("risk"),
    )


def balanced_weights(train: DataFrame, label: str) -> tuple[DataFrame, float]:
    """Weight n / (2 * class size) per row, and the sum of all weights."""
    sizes = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}  # two classes
    n = sum(sizes.values())
    weight = None
    for value, size in sizes.items():
        w = F.lit(n / (len(sizes) * size))
        weight = F.when(F.col(label) == value, w) if weight is None else weight.when(F.col(label) == value, w)
    return train.withColumn("weight", weight), float(n)


def fit_logistic(name: str, dataset: DataFrame, rain: bool, district: bool, max_iter: int = V.LOGISTIC_MAX_ITER) -> Run:
    """Balanced logistic regression; unit penalty on the summed loss, as 1 / sum of weights on the mean."""
    train, test = _halves(stable(splits.mark_stratified(dataset, "label", "row_id"), ["row_id", "label"]))
    inputs = []
    if rain:
        stats = encode.fit_scale(train, V.RAIN_SUMS)
        train, test = encode.apply_scale(train, stats), encode.apply_scale(test, stats)
        inputs += [f"{c}_scaled" for c in V.RAIN_SUMS]
    if district:
        one_hot = encode.fit_one_hot(train, "district_id")
        train, test = (encode.apply_one_hot(one_hot, d, "district_id") for d in (train, test))
        inputs.append("district_id_vec")
    train, total = balanced_weights(train, "label")
    regression = LogisticRegression(
        labelCol="label", featuresCol="features", weightCol="weight", standardization=False,
        maxIter=max_iter, regParam=1.0 / total, elasticNetParam=0.0,
    )
    model = Pipeline(stages=[_vector(inputs), regression]).fit(train)
    values = metrics.classification_metrics(stable(_scored(model.transform(test), "label")))
    if rain and not district:
        values.update({f"coef_{c}": float(w) for c, w in zip(V.RAIN_SUMS, model.stages[-1].coefficients)})
    return Run(name, model, inputs, values)


def prefixes(model: GBTClassificationModel, rounds: list[int]) -> list[GBTClassificationModel]:
    """The boosted model as it was after fewer rounds: its first trees with their weights.

    A round's trees depend on the rounds before it and on the seed, not on how many follow.
    """
    whole, sc = model._java_obj, SparkSession.active().sparkContext
    jvm, gateway = sc._jvm, sc._gateway
    out = []
    for k in rounds:
        trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, k)
        weights = gateway.new_array(jvm.double, k)
        for i, (tree, weight) in enumerate(zip(whole.trees()[:k], whole.treeWeights()[:k])):
            trees[i], weights[i] = tree, float(weight)
        made = jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{model.uid}_{k}", trees, weights, whole.numFeatures(), 2)
        out.append(GBTClassificationModel(made))
    return out


def _drawn(space: dict, draws: int, seed: int) -> list[dict]:
    combos = list(itertools.product(*space.values()))
    return [dict(zip(space, c)) for c in random.Random(seed).sample(combos, min(draws, len(combos)))]


def staged_scores(train: DataFrame, picked: list[dict], folds: int, seed: int, parallelism: int) -> list[float]:
    """Mean ROC-AUC over the folds per setting. Settings that differ in their rounds alone share one fit a fold, at the most
    rounds among them: the shorter ones are scored as its prefixes. `train` has features, label and fold."""
    groups: dict[tuple, list[int]] = {}
    for i, setting in enumerate(picked):
        groups.setdefault(tuple(sorted((k, v) for k, v in setting.items() if k != "maxIter")), []).append(i)
    area = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability", metricName="areaUnderROC", numBins=0)

    def run(job: tuple) -> list[tuple[int, float]]:
        (rest, members), fold = job
        rounds = [picked[i]["maxIter"] for i in members]
        trees = GBTClassifier(
            labelCol="label", featuresCol="features", featureSubsetStrategy="all", seed=seed, maxBins=V.MAX_BINS,
            maxIter=max(rounds), **dict(rest),
        )
        model, held = trees.fit(train.where(F.col("fold") != fold)), train.where(F.col("fold") == fold)
        return [(i, area.evaluate(part.transform(held))) for i, part in zip(members, prefixes(model, rounds))]

    jobs = [(group, fold) for group in groups.items() for fold in range(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        scored = [pair for pairs in pool.map(inheritable_thread_target(run), jobs) for pair in pairs]
    return [sum(s for i, s in scored if i == k) / folds for k in range(len(picked))]


def search_boosting(
    training: DataFrame, draws: int = V.SEARCH_DRAWS, space=None, folds: int = V.CV_FOLDS, seed: int = V.SEED, parallelism: int = 4
) -> Run:
    """Randomised search on the train half by cross-validated ROC-AUC; the winner meets the test half once."""
    space = space or V.SEARCH_SPACE
    train, test = _halves(stable(splits.mark_stratified(training, "label", "row_id"), ["row_id", "label"]))
    ready = stable(_vector(V.LEADLAG_FEATURES).transform(splits.with_fold(train, "row_id", folds)), ["row_id", "label"])
    picked = _drawn(space, draws, seed)
    scores = staged_scores(ready, picked, folds, seed, parallelism)
    best = max(range(len(picked)), key=lambda i: scores[i])
    run = classify("gbt_search", train, test, V.LEADLAG_FEATURES, "label", {**picked[best], "maxBins": V.MAX_BINS}, seed)
    run.values = {"cv_roc_auc": scores[best], **run.values, **{f"param_{k}": float(v) for k, v in picked[best].items()}}
    return run


# --- severity ------------------------------------------------------------


def fit_severity(dataset: DataFrame, params=None, tautology_rate: float = V.TAUTOLOGY_RATE, rate_from: str = "all") -> list[Run]:
    """Hazard alone, all features, and all features without near-certain hazards.

    rate_from="all" takes the hazard rates over the whole table; "train" keeps test labels out of them.
    """
    params = params or V.GBT_SEVERITY
    marked = _laid_out(splits.mark_recent_rows(stable(dataset), "incident_on", "incident_id"), ["incident_id"])
    train, test = _halves(marked)
    sure = profile.tautological(marked if rate_from == "all" else train, train, "hazard_id", "casualty", tautology_rate)
    hard_train, hard_test = (stable(profile.drop_groups(d, sure, "hazard_id")) for d in (train, test))
    fit = lambda *of: lambda: classify(*of, "casualty", params, row_id="incident_id")
    baseline, full, hard = _together([
        fit(V.BASELINE_RUN, train, test, ["hazard_id"]),
        fit(V.FULL_RUN, train, test, V.SEVERITY_FEATURES),
        fit(V.HARD_RUN, hard_train, hard_test, V.SEVERITY_FEATURES),
    ])
    rows = [d.agg(F.count("*").alias("n"), F.avg("casualty").alias("rate")).first() for d in (train, test, hard_train, hard_test)]
    hard.values.update({
        "removed_train": float(rows[0]["n"] - rows[2]["n"]), "removed_test": float(rows[1]["n"] - rows[3]["n"]),
        "test_positive_rate": rows[3]["rate"],
    })
    return [baseline, full, hard]


# --- loss ----------------------------------------------------------------


def _loss_halves(dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _halves(_laid_out(splits.mark_recent_rows(stable(dataset), "incident_on", "incident_id"), ["incident_id"]))


def _regress(name, train, test, features, params) -> Run:
    train, settings = _fitted_rows(train, features, "log_loss", "incident_id", params, averaged=True)
    trees = GBTRegressor(labelCol="log_loss", featuresCol="features", featureSubsetStrategy="all", seed=V.SEED, **settings)
    model = Pipeline(stages=[_vector(features), trees]).fit(train)
    predicted = _predicted(model, test, features, once=settings is not params)
    scored = stable(predicted.select("estimated_loss", F.col("log_loss").alias("actual"), F.col("prediction").alias("predicted")))
    flat = metrics.regression_metrics(scored).first()
    real = metrics.back_transformed_mae(scored, "estimated_loss", "predicted").first()
    return Run(name, model, features, dict(zip(V.LOSS_METRICS, (flat["r2"], flat["mae"], real["mae_real"]))))


def fit_loss(dataset: DataFrame, params=None) -> list[Run]:
    params = params or V.GBT_LOSS
    train, test = _loss_halves(dataset)
    fit = lambda *of: lambda: _regress(*of, params)
    return _together([fit(V.BASELINE_RUN, train, test, ["hazard_id"]), fit(V.FULL_RUN, train, test, V.SEVERITY_FEATURES)])


def tier_table(marked: DataFrame, edges: list[float]) -> DataFrame:
    """half, tier, rows, and the tier's upper edge on the log scale (null for the top one)."""
    half = F.when(F.coalesce("is_test", F.lit(False)), "test").otherwise("train").alias("half")
    upper = F.element_at(F.array(*[F.lit(float(e)) for e in edges], F.lit(None).cast("double")), F.col("tier") + 1)
    counted = marked.groupBy(half, S.tier("log_loss", edges).cast("int").alias("tier")).agg(F.count("*").alias("rows"))
    return counted.withColumn("upper_edge", upper)


def fit_tiers(dataset: DataFrame, params=None) -> Run:
    """Low / medium / high loss: tercile edges from train, one boosted model per class against the rest."""
    train, test = _loss_halves(dataset)
    edges = order_stats.quantiles(train, "log_loss", [1 / 3, 2 / 3])
    train, test = (d.withColumn("tier", S.tier("log_loss", edges).cast("double")) for d in (train, test))
    params = params or V.GBT_LOSS
    train, settings = folded(train, V.SEVERITY_FEATURES, "tier", "incident_id", params)
    if settings is params:
        train = stable(train, ["incident_id"])
    trees = GBTClassifier(featureSubsetStrategy="all", seed=V.SEED, **settings)
    weight = {"weightCol": settings["weightCol"]} if "weightCol" in settings else {}
    rest = OneVsRest(classifier=trees, labelCol="tier", featuresCol="features", parallelism=3, **weight)
    model = Pipeline(stages=[_vector(V.SEVERITY_FEATURES), rest]).fit(train)
    predicted = _predicted(model, test, V.SEVERITY_FEATURES, once=settings is not params)
    scored = stable(predicted.select(F.col("tier").alias("actual"), F.col("prediction").alias("predicted")))
    flat = metrics.multiclass_metrics(scored).first()
    return Run(V.TIER_RUN, model, V.SEVERITY_FEATURES, {
        "accuracy": flat["accuracy"], "f1_macro": flat["f1_macro"], "edge_low": edges[0], "edge_high": edges[1],
    })
