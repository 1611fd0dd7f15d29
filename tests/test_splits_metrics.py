import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilframe.operators import metrics, order_stats, splits, thresholds


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_match_numpy_on_zero_inflated_values(spark, seed):
    rng = random.Random(seed)
    values = [0.0] * 400 + [rng.random() ** 9 * 1e6 for _ in range(700)] + [3.25] * 300
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [p / 100 for p in range(5, 100, 5)] + [0.0, 1.0, 1 / 3]
    assert np.allclose(order_stats.quantiles(df, "v", probs), np.quantile(values, probs), rtol=1e-12)


def test_locate_ranks_refines_extreme_ranges(spark):
    values = sorted([1, 2, 3, 10**15, 10**15 + 1, 10**15 + 2, 2**62])
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = order_stats.locate_ranks(df, F.col("v"), list(range(len(values))))
    assert [g.value for g in got] == values and [g.below for g in got] == list(range(len(values)))


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert order_stats.quantiles(df, "v", [0.5, 1.0]) == [2.0, 3.0]


def test_locate_ranks_out_of_range(spark):
    with pytest.raises(ValueError):
        order_stats.locate_ranks(spark.range(3), F.col("id"), [3])


@pytest.mark.parametrize("take", [0, 1, 333, 334, 999, 1000])
def test_first_rows_with_a_third_on_one_key(spark, take):
    rows = [(7 if i % 3 == 0 else i % 50, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k bigint, id bigint")
    got = sorted(tuple(r) for r in df.where(order_stats.first_rows(df, [F.col("k"), F.col("id")], take)).collect())
    assert got == sorted(rows)[:take]


@pytest.mark.parametrize("by", [(), ("g",)])
def test_running_totals_in_ranges_equal_brute_force(spark, by):
    rows = sorted({(i % 2 if by else 0, float(i % 700) if i % 3 else -5.0 * i): i % 5 for i in range(3000)}.items())
    df = spark.createDataFrame([(g, k, n) for (g, k), n in rows], "g int, k double, n bigint")
    expected, before = [], {}
    for (g, k), n in rows:
        expected.append((g, k, n, before.get(g, 0)))
        before[g] = before.get(g, 0) + n
    for ranges in (None, 1, 13):
        got = order_stats.running_totals(df, "k", ["n"], by, ranges).collect()
        assert sorted((r["g"], r["k"], r["n"], r["n_before"]) for r in got) == expected
        assert all(r["n_total"] == before[r["g"]] for r in got)


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "score double, label int")


TIES = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)]


def test_auc_ties_count_half_and_ap_is_the_step_sum(spark):
    row = metrics.ranking_metrics(scored(spark, TIES)).first()
    assert abs(row["roc_auc"] - 0.75) < 1e-12 and abs(row["average_precision"] - 0.805555555) < 1e-6


def test_ranking_metrics_in_ranges(spark):
    rng = random.Random(1)
    pairs = [(round(rng.random(), 3), int(rng.random() < 0.3)) for _ in range(4000)]
    a = metrics.ranking_metrics(scored(spark, pairs)).first()
    b = metrics.ranking_metrics(scored(spark, pairs), ranges=9).first()
    assert np.allclose([a[0], a[1]], [b[0], b[1]])
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(a["roc_auc"] - brute) < 1e-12


def test_ranking_metrics_need_both_classes(spark):
    row = metrics.ranking_metrics(scored(spark, [(0.1, 1)])).first()
    assert row["roc_auc"] is None and row["average_precision"] is None


def test_ranking_metrics_per_group(spark):
    df = spark.createDataFrame([("a", s, y) for s, y in TIES] + [("b", s, 1 - y) for s, y in TIES], "g string, score double, label int")
    got = {r["g"]: r["roc_auc"] for r in metrics.ranking_metrics(df, by=("g",)).collect()}
    assert abs(got["a"] - 0.75) < 1e-12 and abs(got["b"] - 0.25) < 1e-12


def test_prf_threshold_is_inclusive_and_zero_when_undefined(spark):
    row = metrics.prf_at(scored(spark, [(0.5, 1), (0.4, 1)])).first()
    assert (row["tp"], row["fn"], row["recall"]) == (1, 1, 0.5)
    row = metrics.prf_at(scored(spark, [(0.1, 0)])).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_macro_f1_is_unweighted(spark):
    df = spark.createDataFrame([(0, 0)] * 8 + [(1, 0), (2, 2)], "actual int, predicted int")
    row = metrics.multiclass_metrics(df).first()
    assert abs(row["accuracy"] - 0.9) < 1e-12 and abs(row["f1_macro"] - (16 / 17 + 0 + 1) / 3) < 1e-12


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 2.0), (5.0, 7.0)], "actual double, predicted double")
    row = metrics.regression_metrics(df).first()
    assert abs(row["mae"] - 1) < 1e-12 and abs(row["r2"] - (1 - 5 / 8)) < 1e-12


def test_threshold_keeps_the_first_maximum(spark):
    df = scored(spark, [(0.0, 0), (0.0, 0), (5.0, 1), (5.0, 1)])
    got = thresholds.best(thresholds.score_candidates(df, {"score": [1.0, 2.0, 3.0]})).first()
    assert (got["threshold"], got["train_f1"]) == (1.0, 1.0)


def test_threshold_counts_with_repeated_candidates(spark):
    df = scored(spark, [(0.0, 1), (0.0, 0), (2.0, 1)])
    rows = thresholds.score_candidates(df, {"score": [0.0, 0.0, 2.0]}).orderBy("position").collect()
    assert [(r["tp"], r["fp"], r["fn"]) for r in rows] == [(2, 1, 0), (2, 1, 0), (1, 0, 1)]


def test_last_periods(spark):
    df = spark.createDataFrame([(2023, 12), (2024, 1), (2024, 3), (2024, 7), (2024, 7)], "year int, month int")
    got = sorted((r["year"], r["month"], r["is_test"]) for r in splits.mark_last_periods(df).collect())
    assert [g[2] for g in got] == [False, True, True, True, True]
    few = splits.mark_last_periods(df.where("year = 2023")).collect()
    assert [r["is_test"] for r in few] == [True]


@pytest.mark.parametrize("days,expected", [(1, 1), (9, 1), (10, 2), (14, 2), (15, 3)])
def test_recent_dates_floor_with_minimum_one(spark, days, expected):
    d0 = dt.date(2024, 1, 1)
    rows = [(d0 + dt.timedelta(days=i * 3),) for i in range(days) for _ in range(1 + i % 3)]
    got = splits.mark_recent_dates(spark.createDataFrame(rows, "d date"), "d").where("is_test").select("d").distinct().count()
    assert got == expected


def test_recent_rows_split_ties_by_id(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(days=min(i, 6))) for i in range(10)]  # ids 6..9 share the boundary time
    marked = splits.mark_recent_rows(spark.createDataFrame(rows, "id int, at timestamp"), "at", "id")
    assert sorted(r["id"] for r in marked.where("is_test").collect()) == [8, 9]


def test_recent_rows_without_a_time_are_the_most_recent(spark):
    rows = [(i, None if i < 2 else dt.datetime(1960, 1, 1 + i)) for i in range(10)]
    marked = splits.mark_recent_rows(spark.createDataFrame(rows, "id int, at timestamp"), "at", "id")
    assert sorted(r["id"] for r in marked.where("is_test").collect()) == [0, 1]


def test_recent_rows_of_one_row(spark):
    marked = splits.mark_recent_rows(spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "id int, at timestamp"), "at", "id")
    assert [r["is_test"] for r in marked.collect()] == [True]


def test_splits_are_disjoint_and_exhaustive(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 3 = 0 as int) as label")
    marked = splits.mark_stratified(df, "label", "id")
    train, test = splits.halves(marked)
    assert train.count() + test.count() == 1000 and train.join(test, "id").count() == 0
    assert {r["label"]: r["count"] for r in test.groupBy("label").count().collect()} == {0: 133, 1: 67}
    again = splits.mark_stratified(df.repartition(7), "label", "id")
    assert sorted(r["id"] for r in again.where("is_test").collect()) == sorted(r["id"] for r in test.collect())


def test_folds_are_balanced(spark):
    sizes = [r["count"] for r in splits.with_fold(spark.range(5000), "id").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 250


def test_negatives_avoid_positives_and_keep_the_ratio(spark):
    d0 = dt.date(2024, 1, 1)
    pos = spark.createDataFrame([(1, d0), (2, d0 + dt.timedelta(days=30))], "g int, d date")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5)], "g int, lon double, lat double")
    rows = splits.negative_samples(pos, points, "g", "d").collect()
    assert len({(r["g"], r["d"]) for r in rows}) == 4
    assert not {(r["g"], r["d"]) for r in rows} & {(1, d0), (2, d0 + dt.timedelta(days=30))}
    assert all(d0 <= r["d"] <= d0 + dt.timedelta(days=30) for r in rows)


def test_negatives_say_when_days_run_out(spark):
    pos = spark.createDataFrame([(1, dt.date(2024, 1, d)) for d in range(1, 9)], "g int, d date")
    points = spark.createDataFrame([(1, 80.0, 27.0), (2, 80.0, 27.0)], "g int, lon double, lat double")
    with pytest.raises(ValueError, match="16 negatives asked for, 8 free"):
        splits.negative_samples(pos, points, "g", "d")
    rows = splits.negative_samples(pos, points, "g", "d", allow_fewer=True).collect()
    assert len(rows) == 8 and {r["achieved_ratio"] for r in rows} == {1.0}


def test_halves_hold_every_row(spark):
    rows = [(i, None if i == 3 else dt.date(2024, 1, 1 + i), None if i == 4 else i % 3) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, d date, label int")
    for marked in (splits.mark_recent_dates(df, "d"), splits.mark_stratified(df, "label", "id"), splits.mark_stratified(df, "label", "id", (0, 1))):
        train, test = splits.halves(marked)
        assert sorted(r["id"] for r in train.unionByName(test).collect()) == list(range(20)) and test.count() > 0
    three = splits.mark_stratified(df, "label", "id").where("is_test").groupBy("label").count().collect()
    assert {r["label"] for r in three} >= {0, 1, 2}
    with pytest.raises(TypeError):
        splits.mark_recent_dates(df.withColumn("d", df["d"].cast("timestamp")), "d")


def test_ranks_over_the_whole_long_range(spark):
    ids = [-(1 << 63), -5, 0, 7, (1 << 63) - 1] + [x * 0x123456789ABCDEF % (1 << 64) - (1 << 63) for x in range(1, 200)]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    found = order_stats.locate_ranks(df, F.col("id"), range(len(set(ids))))
    assert [f.value for f in found] == sorted(ids)[: len(found)]
