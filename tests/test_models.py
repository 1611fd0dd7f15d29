import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from perilframe import fixed_values as V
from perilframe.operators import grids
from perilframe.plans import jobs, models, runlog

TREES = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3, "minInstancesPerNode": 2, "subsamplingRate": 0.85}


@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        wet = rng.random()
        r1 = wet * 30
        rows.append((i, i % 7, dt.date(2024, 1, 1) + dt.timedelta(days=i // 5), r1, r1 + 2, r1 + 5, r1, int(rng.random() < wet)))
    return spark.createDataFrame(
        rows, "row_id bigint, district_id int, sample_date date, rain_1d double, rain_3d double, rain_7d double, rain_peak_7d double, label int"
    ).withColumn("month", F.month("sample_date"))


def test_leadlag_learns_and_repeats(spark, training):
    a = models.fit_leadlag(training, TREES)
    b = models.fit_leadlag(training.repartition(5), TREES)
    assert a.values["roc_auc"] > 0.7 and a.values == b.values
    top = models.importance_table(spark, a).first()["feature"]
    assert top.startswith("rain")


def test_logistic_runs(training):
    rain = models.fit_logistic("r", training, rain=True, district=False)
    both = models.fit_logistic("b", training, rain=True, district=True)
    only = models.fit_logistic("d", training, rain=False, district=True)
    assert rain.values["roc_auc"] > 0.7 and both.values["roc_auc"] > 0.7 and only.values["roc_auc"] < 0.65
    assert "coef_rain_1d" in rain.values


def test_search_reports_the_winner(training):
    space = {"maxIter": [2, 3], "maxDepth": [2], "stepSize": [0.1, 0.3], "minInstancesPerNode": [5], "subsamplingRate": [1.0]}
    run = models.search_boosting(training, draws=2, space=space, folds=2)
    assert run.values["cv_roc_auc"] > 0.7 and run.values["param_maxIter"] in (2.0, 3.0)


def test_prefixes_equal_separate_fits(training):
    """Settings that differ in their rounds share a fit; the scores are those of fits of their own."""
    import random as rnd

    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    ready = models._vector(V.LEADLAG_FEATURES).transform(models.splits.with_fold(training, "row_id", 2))
    ready = models.stable(ready, ["row_id"])
    rest = {"maxDepth": 3, "stepSize": 0.2, "minInstancesPerNode": 5, "subsamplingRate": 0.85}
    picked = [{"maxIter": n, **rest} for n in (2, 5, 3)] + [{"maxIter": 2, **rest, "maxDepth": 2}]
    got = models.staged_scores(ready, picked, 2, 7, 2)
    area = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="probability", metricName="areaUnderROC", numBins=0)
    for setting, score in zip(picked, got):
        trees = GBTClassifier(labelCol="label", featuresCol="features", featureSubsetStrategy="all", seed=7, maxBins=V.MAX_BINS, **setting)
        alone = [area.evaluate(trees.fit(ready.where(F.col("fold") != f)).transform(ready.where(F.col("fold") == f))) for f in (0, 1)]
        assert score == pytest.approx(sum(alone) / 2, abs=1e-12)
    drawn = models._drawn(V.SEARCH_SPACE, 30, 42)
    assert len(drawn) == 30 and drawn == models._drawn(V.SEARCH_SPACE, 30, 42) and rnd.Random(42).random() != drawn


def test_search_is_logged(spark, training, tmp_path):
    space = {"maxIter": [2, 3], "maxDepth": [2], "stepSize": [0.3], "minInstancesPerNode": [5], "subsamplingRate": [1.0]}
    log = str(tmp_path / "runs")
    run = jobs.retrain_search(training, log, str(tmp_path / "models"), 2, space, 2)
    kept = {(r["kind"], r["key"]): r["value"] for r in runlog.read(spark, log).collect()}
    assert kept["param", "maxIter"] in ("2.0", "3.0") and float(kept["metric", "cv_roc_auc"]) == run.values["cv_roc_auc"]
    assert runlog.load_latest(spark, jobs.SEARCH_MODEL, log).transform(training).count() == 1500


def test_rows_without_rain_are_dropped_and_counted(spark, training):
    holed = training.withColumn("rain_3d", F.when(F.col("row_id") % 10 != 0, F.col("rain_3d")))
    kept, dropped = models.with_rain(holed)
    assert dropped == 150 and kept.count() == 1350 and kept.where("rain_3d is null").count() == 0


def test_search_space_is_the_full_one():
    n = 1
    for values in V.SEARCH_SPACE.values():
        n *= len(values)
    assert (n, V.SEARCH_DRAWS) == (768, 30)


def test_counts_model_and_batch_scores(spark):
    rows = [(f"d{d}", h, 2020 + m // 12, m % 12 + 1, (d + 1) * (1 + (m % 12 in (5, 6, 7)) * 3)) for d in range(4) for h in ("x", "y") for m in range(36)]
    counts = spark.createDataFrame(rows, "district string, hazard string, year int, month int, incident_count bigint")
    grid = grids.full_grid(counts)
    run, scored = models.fit_counts(grids.panel_features(grid), {"numTrees": 10, "maxDepth": 5, "minInstancesPerNode": 1})
    assert run.values["r2"] > 0.8 and scored.count() == 24
    served = models.score_counts(run.model, grids.serving_features(grid.drop("incident_count"), counts))
    assert served.count() == len(rows)
    assert served.where("predicted_incident_count < 0 or risk is null").count() == 0


def test_severity_loss_and_tiers(spark, training, tmp_path):
    data = training.select(
        F.col("row_id").alias("incident_id"), F.col("sample_date").cast("timestamp").alias("incident_on"),
        (F.col("row_id") % 4).cast("int").alias("hazard_id"), "district_id", "month", F.lit(1).alias("day_of_week"), *V.RAIN_ALL,
        F.when(F.col("row_id") % 4 == 0, 1).otherwise(F.col("label")).alias("casualty"),
        F.exp(F.col("rain_1d") / 5).alias("estimated_loss"),
    ).withColumn("log_loss", F.log1p("estimated_loss"))
    runs = {r.name: r for r in models.fit_severity(data, TREES)}
    table = models.result_table(spark, list(runs.values()))
    lift = {r["run"]: r["lift"] for r in runlog.lift(table, "hazard_only_baseline", "roc_auc").collect()}
    assert lift["hazard_only_baseline"] == 0.0 and lift["full_features"] > 0.05
    loss = {r.name: r.values for r in models.fit_loss(data, TREES)}
    assert loss["full_features"]["r2_log_scale"] > loss["hazard_only_baseline"]["r2_log_scale"]
    tiers = models.fit_tiers(data, TREES)
    assert tiers.values["accuracy"] > 0.6
    shares = {r["feature"]: r["importance"] for r in models.importance_table(spark, tiers).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-6 and max(shares, key=shares.get).startswith("rain")
    log, root = str(tmp_path / "runs"), str(tmp_path / "models")
    small = {**TREES, "maxIter": 2}
    jobs.retrain_severity(data, log, root, small)
    jobs.retrain_loss(data, log, root, small)
    jobs.retrain_tiers(data, log, root, small)
    logged = runlog.read(spark, log)
    assert {r["name"] for r in logged.where("kind = 'model'").collect()} == {
        "incident-severity-hazard_only_baseline", "incident-severity-full_features", "incident-severity-full_features_hard_subset",
        "incident-loss-hazard_only_baseline", "incident-loss-full_features", "incident-loss-tiers",
    }
    kept = {(r["key"], r["value"]) for r in logged.where("name = 'incident-loss-tiers'").collect()}
    assert ("features", ",".join(V.SEVERITY_FEATURES)) in kept and ("split_method", "most_recent_rows") in kept
    assert ("target", jobs.TIER_TARGET) in kept
    assert {r["value"] for r in logged.where("key = 'target' and name like 'incident-loss-f%'").collect()} == {jobs.LOSS_TARGET}
    hard = runs["full_features_hard_subset"].values
    assert hard["removed_train"] + hard["removed_test"] == 375 and 0 < hard["test_positive_rate"] < 1


def _many_equal(spark, n=6000):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        a, b = rng.randrange(6), rng.randrange(4)
        rows.append((i, float(a), b, int(rng.random() < (a + b) / 9), a * 1.5 + b + rng.random()))
    return spark.createDataFrame(rows, "row_id bigint, a double, b int, label int, log_loss double")


@pytest.mark.parametrize("least", [1, 40])
def test_a_fold_of_equal_rows_gives_the_same_trees(spark, monkeypatch, least):
    """24 combinations of features in 6,000 rows: the weighted rows are few, and their trees score as those of all rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    data = models.stable(_many_equal(spark), ["row_id"])
    settings = {"maxIter": 8, "maxDepth": 4, "stepSize": 0.3, "minInstancesPerNode": least}
    assert models.folded(data, ["a", "b"], "label", "row_id", settings)[0] is data  # not large
    monkeypatch.setattr(models, "FEW_ROWS", 100)
    for kind, label, averaged in ((GBTClassifier, "label", False), (GBTRegressor, "log_loss", True)):
        few, weighed = models.folded(data, ["a", "b"], label, "row_id", settings, averaged)
        assert few.count() <= 48 and few.agg(F.sum("weight")).first()[0] == 6000
        ready = [models._vector(["a", "b"]).transform(d) for d in (data, few)]
        said = []
        for rows, of in zip(ready, (settings, weighed)):
            model = kind(labelCol=label, featureSubsetStrategy="all", seed=1, **of).fit(rows)
            column = models.vector_to_array("probability")[1] if label == "label" else F.col("prediction")
            cells = model.transform(ready[0]).select("a", "b", column.alias("p")).distinct().collect()
            said.append({(r["a"], r["b"]): r["p"] for r in cells})
        assert said[0].keys() == said[1].keys()
        assert all(said[0][k] == pytest.approx(said[1][k], abs=1e-9) for k in said[0])


def test_a_fold_keeps_parts_to_draw_from(spark, monkeypatch):
    """With drawing, a combination stays in parts; a half that a fold would not halve stays as it is; a missing label is not averaged away."""
    data = models.stable(_many_equal(spark), ["row_id"])
    monkeypatch.setattr(models, "FEW_ROWS", 300)
    few, weighed = models.folded(data, ["a", "b"], "label", "row_id", TREES)
    assert 24 * models.LEAST_PARTS <= few.count() <= 400 and weighed["weightCol"] == "weight"
    assert few.agg(F.sum("weight")).first()[0] == 6000
    assert models.folded(data, ["row_id"], "label", "row_id", TREES) == (data, TREES)
    whole = models.classify("x", data, data, ["a", "b"], "label", TREES).values
    parts = models.classify("x", data, data, ["a", "b"], "label", TREES, row_id="row_id").values
    assert parts["roc_auc"] == pytest.approx(whole["roc_auc"], abs=0.02)
    holed = data.withColumn("log_loss", F.when(F.col("row_id") != 7, F.col("log_loss")))
    assert models.folded(holed, ["a", "b"], "log_loss", "row_id", TREES, True)[0].where("log_loss is null").count() == 1


@pytest.mark.parametrize("values, column", [(47, "hazard_id"), (77, "district_id")])
def test_every_code_can_be_split(spark, values, column):
    """A label that the code alone decides is learned exactly, however many codes there are."""
    rng = random.Random(values)
    odd = {c: rng.random() < 0.5 for c in range(values)}
    rows = [(i, i % values, float(odd[i % values])) for i in range(values * 60)]
    data = spark.createDataFrame(rows, f"row_id bigint, {column} int, label double")
    settings = {**V.GBT_SEVERITY, "maxIter": 20, "maxDepth": 5}
    run = models.classify("codes", data.where("row_id % 3 > 0"), data.where("row_id % 3 = 0"), [column], "label", settings)
    assert run.values["roc_auc"] == 1.0 and run.values["recall"] >= 0.99
    assert all(s["maxBins"] >= 77 for s in (V.RF_COUNTS, V.GBT_LEADLAG, V.GBT_SEVERITY, V.GBT_LOSS, V.GBT_DEFAULT))


def test_jobs_use_the_newest_saved_model(spark, tmp_path, training):
    log, root = str(tmp_path / "runs"), str(tmp_path / "models")
    rows = [(d, h, 2022 + m // 12, m % 12 + 1, 1 + (m % 12 == 6) * 9) for d in ("A", "B") for h in ("x", "y") for m in range(30)]
    counts = spark.createDataFrame(rows, "district string, hazard string, year int, month int, incident_count bigint")
    panel = grids.panel_features(grids.full_grid(counts))
    with pytest.raises(Exception):
        jobs.find_anomalies(panel, log)
    small = {"numTrees": 3, "maxDepth": 1, "minInstancesPerNode": 1}
    jobs.retrain_counts(panel, log, root, small)
    run = jobs.retrain_counts(panel, log, root, {**small, "numTrees": 12, "maxDepth": 5})
    fresh = models.score_counts(run.model, grids.serving_features(grids.full_grid(counts), counts))
    asked = grids.full_grid(counts).drop("incident_count").unionByName(
        spark.createDataFrame([("Mars", "x", 2024, 1)], "district string, hazard string, year int, month int"))
    scored, rejected = jobs.predict_counts(asked, counts, log)
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, fresh.collect()))
    assert [r["reason"] for r in rejected.collect()] == ["unknown district or hazard"]
    assert jobs.find_anomalies(panel, log).count() == 12
    metrics = runlog.metrics_of(runlog.read(spark, log), runlog.latest(runlog.read(spark, log)))
    assert {r["key"] for r in metrics.collect()} == {"mae", "rmse", "r2"}

    jobs.retrain_leadlag(training, log, root, TREES)
    daily = training.dropDuplicates(["district_id", "sample_date"]).select("district_id", "sample_date", *V.RAIN_ALL)
    places = spark.range(7).selectExpr("cast(id as int) as id", "concat('D', id) as title")
    asked = spark.createDataFrame([("D1", "2024-01-01"), ("D1", "2030-01-01")], "district string, date string")
    scored, rejected = jobs.predict_hazard(asked, places, daily, log)
    assert scored.count() + rejected.count() == 2 and rejected.count() >= 1
    assert scored.where("risk_probability < 0 or risk_probability > 1").count() == 0


def test_a_fold_stays_small_with_many_combinations(spark, monkeypatch):
    """3,000 combinations, one of them with a third of the rows: no more rows than the combinations and twice FEW_ROWS, none that weighs a lot."""
    rows = [(i, float(i % 2999 + 1) if i % 3 else 0.0, i % 2) for i in range(30_000)]
    data = models.stable(spark.createDataFrame(rows, "row_id bigint, a double, label int"), ["row_id"])
    monkeypatch.setattr(models, "FEW_ROWS", 1000)
    for label, averaged in (("label", False), ("row_id", True)):
        few, weighed = models.folded(data, ["a"], label, "row_id", TREES, averaged)
        combinations = data.select("a", *([] if averaged else ["label"])).distinct().count()
        assert "weightCol" in weighed and combinations < few.count() <= combinations + 2 * models.FEW_ROWS
        assert few.agg(F.sum("weight")).first()[0] == 30_000
        assert few.agg(F.max("weight")).first()[0] <= 60
        sums = few.groupBy("a").agg(F.sum("weight").alias("w")).join(data.groupBy("a").count(), "a")
        assert sums.where("w <> count").count() == 0


def test_a_large_half_is_not_sorted_by_row(spark, training, monkeypatch):
    """Folded rows have their own layout, so the half before them needs none; each combination of the test half is scored once, for all its rows."""
    data = training.withColumns({c: F.floor(F.col(c) / 10) for c in V.RAIN_ALL}).withColumn("month", F.lit(1))
    orders, scored = [], []
    write, predict = models.stable, models._predicted
    monkeypatch.setattr(models, "stable", lambda df, order=None: (orders.append(order), write(df, order))[1])
    monkeypatch.setattr(models, "_predicted", lambda *of, once: (scored.append((of, predict(*of, once=once))), scored[-1][1])[1])
    monkeypatch.setattr(models, "FEW_ROWS", 100)
    run = models.fit_leadlag(data, TREES)
    assert ["row_id", "label"] not in orders and run.values["roc_auc"] > 0.6
    (model, test, _), once = scored[0]
    assert sorted(once.select("row_id", "prediction").collect()) == sorted(model.transform(test).select("row_id", "prediction").collect())
