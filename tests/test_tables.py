import datetime as dt

import pytest
from pyspark.sql import functions as F

from perilframe import fixed_values as V
from perilframe.functions import scalar as S
from perilframe.operators import encode, grids, listing, profile, quality, rain
from perilframe.plans import anomaly, datasets, requests, runlog

C = "district string, hazard string, year int, month int, incident_count bigint"


def test_grid_has_only_observed_periods(spark):
    counts = spark.createDataFrame([("north", "hail", 2011, 3, 9), ("north", "hail", 2011, 12, 4), ("north", "hail", 2015, 6, 2)], C)
    assert {(r["year"], r["month"]) for r in grids.full_grid(counts).collect()} == {(2011, 3), (2011, 12), (2015, 6)}


def test_grid_zero_fills(spark):
    counts = spark.createDataFrame([("north", "hail", 2011, 3, 9), ("south", "frost", 2011, 3, 6)], C)
    rows = [r for r in grids.full_grid(counts).collect() if (r["district"], r["hazard"]) == ("north", "frost")]
    assert [r["incident_count"] for r in rows] == [0]


def test_grid_uses_no_cross_join(spark):
    counts = spark.createDataFrame([("a", "x", 2024, 7, 5)], C)
    plan = grids.full_grid(counts)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lag_follows_observed_periods_serving_follows_the_calendar(spark):
    counts = spark.createDataFrame([("a", "x", 2024, 7, 5), ("a", "x", 2024, 9, 2)], C)
    lagged = grids.panel_features(grids.full_grid(counts)).collect()
    assert [(r["month"], r["prev_month_count"]) for r in lagged] == [(9, 5)]
    asked = spark.createDataFrame([("a", "x", 2024, 9), ("a", "x", 2024, 8), ("a", "x", 2025, 1), ("a", "y", 2024, 8)], "district string, hazard string, year int, month int")
    served = {(r["hazard"], r["year"], r["month"]): (r["prev_month_count"], r["historical_month_avg"]) for r in grids.serving_features(asked, counts).collect()}
    assert served == {("x", 2024, 9): (0, 2.0), ("x", 2024, 8): (5, 0.0), ("x", 2025, 1): (0, 0.0), ("y", 2024, 8): (0, 0.0)}


def test_january_looks_back_to_december(spark):
    counts = spark.createDataFrame([("a", "x", 2023, 12, 4)], C)
    asked = spark.createDataFrame([("a", "x", 2024, 1)], "district string, hazard string, year int, month int")
    assert grids.serving_features(asked, counts).first()["prev_month_count"] == 4


def test_historical_mean_counts_zero_years_before_the_lag_drop(spark):
    # July 2023 is the first period, so it is dropped, but its 4 is in the mean; y has a zero July 2024.
    counts = spark.createDataFrame([("a", "x", 2023, 7, 4), ("a", "y", 2024, 7, 1), ("a", "y", 2023, 7, 1)], C)
    rows = {(r["hazard"], r["year"]): r["historical_month_avg"] for r in grids.panel_features(grids.full_grid(counts)).collect()}
    assert rows == {("x", 2024): 2.0, ("y", 2024): 1.0}
    served = grids.serving_features(spark.createDataFrame([("a", "x", 2024, 7)], "district string, hazard string, year int, month int"), counts)
    assert served.first()["historical_month_avg"] == 4.0


def test_expanding_mean_sees_only_the_past(spark):
    counts = spark.createDataFrame([("a", "x", y, 7, n) for y, n in ((2022, 1), (2023, 3), (2024, 9))], C)
    rows = {r["year"]: r["historical_month_avg"] for r in grids.panel_features(grids.full_grid(counts), "expanding").collect()}
    assert rows == {2023: 1.0, 2024: 2.0}


def test_counts_merge_equal_titles_and_filter_hazards(spark):
    at = dt.datetime(2024, 7, 1)
    inc = spark.createDataFrame([(1, 1, at), (2, 1, at), (1, 2, at), (None, 1, at)], "district_id int, hazard_id int, incident_on timestamp")
    d = spark.createDataFrame([(1, "A"), (2, "A")], "id int, title string")
    h = spark.createDataFrame([(1, "Fire"), (2, "Storm")], "id int, title string")
    rows = grids.monthly_counts(inc, d, h, V.PANEL_HAZARDS).collect()
    assert [tuple(r) for r in rows] == [("A", "Fire", 2024, 7, 2)]


D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n - 1)


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([(0, 0, day(1), 5.0), (0, 0, day(2), 1.0), (0, 0, day(10), 2.0)], "cell_x int, cell_y int, date date, precip_mm double")


G = rain.Geometry(80.0, 26.0, 0.05)


def samples(spark, *days, lon=80.01):
    return spark.createDataFrame([(i, day(n), lon, 26.01) for i, n in enumerate(days)], "id int, d date, lon double, lat double")


def test_windows_exclude_the_day_and_sum_partial_coverage(spark, gaps):
    got = {r["d"]: tuple(r[c] for c in V.RAIN_ALL) for r in rain.at_points(samples(spark, 2, 3, 8, 9, 11), gaps, G, "d", "lon", "lat", 7).collect()}
    assert got == {day(2): (5.0, 5.0, 5.0, 5.0), day(3): (1.0, 6.0, 6.0, 5.0), day(8): (None, None, 6.0, 5.0), day(9): (None, None, 1.0, 1.0), day(11): (2.0, 2.0, 2.0, 2.0)}


def test_gates_differ(spark, gaps):
    one = rain.at_points(samples(spark, 3, 8, 10), gaps, G, "d", "lon", "lat", 1)
    seven = rain.at_points(samples(spark, 3, 8, 10), gaps, G, "d", "lon", "lat", 7)
    assert sorted(r["d"] for r in one.collect()) == [day(3)]
    assert sorted(r["d"] for r in seven.collect()) == [day(3), day(8)]


def test_missing_pixel_keeps_the_sample(spark, gaps):
    rows = rain.at_points(samples(spark, 3, lon=81.0), gaps, G, "d", "lon", "lat", 1).collect()
    assert [(r["rain_1d"], r["rain_7d"]) for r in rows] == [(None, None)]


def test_panel_windows(spark, gaps):
    got = {r["date"]: (r["rain_1d"], r["rain_3d"], r["rain_peak_7d"]) for r in rain.panel_windows(gaps, ["cell_x", "cell_y"], "date", "precip_mm").collect()}
    assert got == {day(1): (None, None, None), day(2): (5.0, 5.0, 5.0), day(10): (None, None, None)}


def test_coverage(spark, gaps):
    rows = {r["d"]: (r["images_1d"], r["images_3d"], r["images_7d"]) for r in rain.coverage(samples(spark, 2, 3, 8, 30), gaps, "d").collect()}
    assert rows == {day(2): (1, 1, 1), day(3): (1, 2, 2), day(8): (0, 0, 2), day(30): (0, 0, 0)}


def test_daily_rain_needs_all_four_values(spark, gaps):
    points = spark.createDataFrame([(7, 80.01, 26.01), (8, 81.0, 26.01)], "district_id int, lon double, lat double")
    days = spark.createDataFrame([(day(3),), (day(5),), (day(20),)], "sample_date date")
    rows = rain.daily_rain(points, gaps, G, days, "district_id").collect()
    assert [(r["district_id"], r["sample_date"]) for r in rows] == [(7, day(3))]


def test_centroid_is_that_of_the_smallest_id(spark):
    s = spark.createDataFrame([(2, 1, 5.0, 5.0), (1, 1, 3.0, 4.0)], "id int, g int, lon double, lat double")
    assert tuple(rain.centroids(s, "g", "lon", "lat", "id").first()) == (1, 3.0, 4.0)


def test_weekday_rounding_bands_tiers(spark):
    one = spark.range(1)
    monday = F.lit(dt.date(2024, 1, 1))
    row = one.select(
        S.monday_zero(monday).alias("wd"), S.clip_round(F.lit(0.125)).alias("even"), S.clip_round(F.lit(-3.0)).alias("neg"),
        S.count_band(F.lit(2)).alias("c2"), S.count_band(F.lit(1.99)).alias("c1"), S.count_band(F.lit(6)).alias("c6"),
        S.probability_band(F.lit(0.3)).alias("p3"), S.probability_band(F.lit(0.6)).alias("p6"),
        S.tier(F.lit(1.0), [1.0, 2.0]).alias("t0"), S.tier(F.lit(2.0), [1.0, 2.0]).alias("t1"), S.tier(F.lit(2.1), [1.0, 2.0]).alias("t2"),
        S.is_monsoon(F.lit(5)).alias("m5"), S.is_monsoon(F.lit(9)).alias("m9"), S.percent_label(F.lit(0.125)).alias("pc"),
    ).first()
    assert tuple(row) == (0, 0.12, 0.0, "Moderate", "Low", "High", "Moderate", "High", 0, 1, 2, False, True, 13)


def test_list_newest_first_unknown_time_on_top(spark):
    cols = "id int, title string, title_ne string, hazard_id int, incident_on timestamp, reported_on timestamp, verified boolean, approved boolean, lat double, lon double"
    at = dt.datetime(2026, 7, 15)
    inc = spark.createDataFrame([(1, "a", None, 17, at, None, True, None, 28.3, 82.6), (2, "b", None, None, None, None, None, None, None, None), (3, "c", None, 17, at + dt.timedelta(days=1), None, None, None, None, None)], cols)
    haz = spark.createDataFrame([(17, "Landslide", None, "natural", "#6D4C41", None), (20, "Snake Bite", None, "non natural", "#AB47BC", None)], "id int, title string, title_ne string, type string, color string, icon_url string")
    rows = listing.incident_list(inc, haz).collect()
    assert [r["id"] for r in rows] == [2, 3, 1]
    assert rows[0]["hazard"] is None and rows[2]["hazard"]["title"] == "Landslide"
    assert (rows[2]["latitude"], rows[2]["longitude"]) == (28.3, 82.6)
    assert [r["id"] for r in listing.incident_list(inc, haz, page=2, size=2).collect()] == [1]
    assert [r["id"] for r in listing.incidents_after(inc, haz, at + dt.timedelta(days=1), 3).collect()] == [1]
    assert [r["id"] for r in listing.incidents_after(inc, haz, None, 2, 1).collect()] == [3]
    assert [r["id"] for r in listing.incidents_after(inc, haz, None, 1).collect()] == [2, 3, 1]
    assert listing.positions(inc, [3, 1, 2]) == [(at, 1), (None, 2), (at + dt.timedelta(days=1), 3)]
    assert listing.total(inc).first()["count"] == 3
    assert [r["title"] for r in listing.hazard_list(haz).collect()] == ["Landslide", "Snake Bite"]


def test_positions_are_those_of_the_whole_order(spark):
    """Undated rows ahead, many rows of one time, a repeated row: each place gives the row that the full order has there."""
    at = dt.datetime(2026, 7, 15)
    rows = [(i, None if i % 5 == 0 else at - dt.timedelta(days=i % 3)) for i in range(1, 400)] + [(7, at - dt.timedelta(days=1))]
    inc = spark.createDataFrame(rows, "id bigint, incident_on timestamp").repartition(7)
    whole = [tuple(r) for r in inc.orderBy(F.desc_nulls_first("incident_on"), "id").select("incident_on", "id").collect()]
    places = [1, 60, 79, 80, 200, 213, 214, 400]
    assert listing.positions(inc, places) == [whole[p - 1] for p in places]
    with pytest.raises(ValueError):
        listing.positions(inc, [401])


def test_map_drops_zero_only_when_drawing(spark):
    inc = spark.createDataFrame([(1, 17, None, 0.0, 82.6), (2, 17, None, 28.0, 82.6), (3, 17, None, None, None)], "id int, hazard_id int, incident_on timestamp, lat double, lon double")
    haz = spark.createDataFrame([(17, "Landslide", "#1")], "id int, title string, color string")
    points = listing.incident_map(inc, haz)
    assert points.count() == 2 and [r["id"] for r in listing.drawable(points).collect()] == [2]
    assert tuple(listing.map_legend(points).first()) == ("Landslide", "#1", 1)


def dq(spark, rows):
    return {r["rule"]: r for r in quality.report(
        spark.createDataFrame(rows, "id int, hazard_id int, incident_on timestamp, loss_id int, longitude double, latitude double"),
        quality.incident_rules(dt.datetime(2026, 1, 1))).collect()}


def test_quality_edges(spark):
    ok = dt.datetime(2025, 1, 1)
    rows = [(i, 1, ok, None, 80.0, 26.3) for i in range(98)] + [(98, 47, ok, None, 88.3, 31.0), (99, 48, ok, None, 88.3, 31.0)]
    got = dq(spark, rows)
    assert got["between(latitude)"]["success"] and got["between(latitude)"]["unexpected"] == 2  # exactly 98 %
    assert got["between(longitude)"]["unexpected"] == 0  # inclusive bounds
    assert got["between(loss_id)"]["success"] and got["between(loss_id)"]["evaluated"] == 0  # all null
    assert not got["in_set(hazard_id)"]["success"] and got["in_set(hazard_id)"]["unexpected"] == 1


def test_quality_nulls_duplicates_future(spark):
    got = dq(spark, [(1, None, None, 0, None, None), (1, 2, dt.datetime(2026, 1, 2), 1, None, None), (None, 2, dt.datetime(2026, 1, 1), 1, None, None), (2, 2, dt.datetime(2025, 1, 1), 1, None, None)])
    assert got["unique(id)"]["unexpected"] == 2 and got["unique(id)"]["evaluated"] == 3
    assert got["not_null(id)"]["unexpected"] == 1 and got["not_null(incident_on)"]["unexpected"] == 1
    assert got["between(incident_on)"]["unexpected"] == 1 and got["in_set(hazard_id)"]["evaluated"] == 3
    assert got["between(loss_id)"]["unexpected"] == 1
    with pytest.raises(ValueError):
        quality.require(spark.createDataFrame([("r", False)], "rule string, success boolean"))


def test_datasets_filter_rain_only_for_leadlag(spark):
    at = dt.datetime(2024, 7, 1)
    rainy = spark.createDataFrame([(1, at.date(), 1.0, 2.0, 3.0, 2.0), (2, at.date(), None, 2.0, 3.0, 2.0)], "incident_id bigint, incident_date date, rain_1d double, rain_3d double, rain_7d double, rain_peak_7d double")
    inc = spark.createDataFrame([(1, 17, 5, at, '{"loss":{"peopleInjuredCount":1,"estimatedLoss":99}}'), (2, 17, 5, at, '{"loss":3}'), (3, 17, 5, at, None)], "id bigint, hazard_id int, district_id int, incident_on timestamp, raw_data string")
    neg = spark.createDataFrame([(9, 5, at.date(), 0.0, 0.0, 0.0, 0.0), (10, None, at.date(), 0.0, 0.0, None, 0.0)], "id int, district_id int, sample_date date, rain_1d double, rain_3d double, rain_7d double, rain_peak_7d double")
    assert sorted((r["row_id"], r["label"]) for r in datasets.leadlag_dataset(rainy, inc, neg).collect()) == [(1, 1), (9, 0)]
    assert sorted((r["incident_id"], r["casualty"]) for r in datasets.severity_dataset(inc, rainy).collect()) == [(1, 1), (2, 0)]
    loss = datasets.loss_dataset(inc, rainy).collect()
    assert [(r["incident_id"], r["estimated_loss"]) for r in loss] == [(1, 99.0)] and abs(loss[0]["log_loss"] - 4.60517) < 1e-5


def test_tautology_needs_train_and_rate_over_all_rows(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 0), (3, 1)], "hazard_id int, casualty int")
    train = rows.where("hazard_id in (1, 3)")
    assert [r[0] for r in profile.tautological(rows, train, "hazard_id", "casualty").collect()] == [1]


def test_one_hot_unseen_and_null_are_zero(spark):
    from pyspark.ml.functions import vector_to_array

    train = spark.createDataFrame([("a",), ("b",)], "k string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    model = encode.fit_one_hot(train, "k")
    got = {r["k"]: list(r["v"]) for r in encode.apply_one_hot(model, test, "k").select("k", vector_to_array("k_vec").alias("v")).collect()}
    assert got == {"a": [1.0, 0.0], "z": [0.0, 0.0], None: [0.0, 0.0]}


def test_scale_population_deviation_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = encode.apply_scale(df, encode.fit_scale(df, ["a", "b"])).collect()
    assert sorted((r["a_scaled"], r["b_scaled"]) for r in rows) == [(-1.0, 0.0), (1.0, 0.0)]


def test_anomaly_uses_the_rounded_prediction(spark):
    df = spark.createDataFrame([("a", "x", 2024, 7, 26, 6.104), ("b", "x", 2024, 7, 0, -2.0)], C + ", p double")
    rows = {r["district"]: r for r in anomaly.anomaly_report(df, "p").collect()}
    assert rows["a"]["predicted"] == 6.1 and abs(rows["a"]["residual"] - 19.9) < 1e-9
    assert abs(rows["a"]["surprise_ratio"] - 27 / 7.1) < 1e-9 and rows["b"]["surprise_ratio"] == 1.0


def test_count_requests(spark):
    names = spark.createDataFrame([(1, "Rolpa")], "id int, title string")
    kinds = spark.createDataFrame([(1, "Fire")], "id int, title string")
    asked = spark.createDataFrame([(1, "Rolpa", "Fire", "2024", "13"), (2, "Rolpa", None, "2024", "1"), (3, "Rolpa", "Fire", "2024", "0"), (4, "Rolpa", "Fire", "x", "1"), (5, "Mars", "Fire", "2024", "1")], "id int, district string, hazard string, year string, month string")
    got = {r["id"]: r["reason"] for r in requests.judge_count_requests(asked, names, kinds).collect()}
    assert got == {1: None, 2: "missing field", 3: "missing field", 4: "year and month must be integers", 5: "unknown district or hazard"}


def test_hazard_requests(spark):
    names = spark.createDataFrame([(1, "Rolpa")], "id int, title string")
    daily = spark.createDataFrame([(1, dt.date(2024, 7, 1), 1.0, 2.0, 3.0, 2.0)], "district_id int, sample_date date, rain_1d double, rain_3d double, rain_7d double, rain_peak_7d double")
    asked = spark.createDataFrame([(1, "Rolpa", "2024-07-01"), (2, "Rolpa", "2024-07-02"), (3, "Rolpa", "2024-02-31"), (4, "Mars", "2024-07-01"), (5, None, "2024-07-01")], "id int, district string, date string")
    judged = requests.judge_hazard_requests(asked, names, daily)
    assert {r["id"]: r["reason"] for r in judged.collect()} == {1: None, 2: "no rainfall data", 3: "date must be YYYY-MM-DD", 4: "unknown district", 5: "missing field"}
    row = requests.accepted(judged).first()
    assert (row["district_id"], row["month"], row["rain_7d"]) == (1, 7, 3.0)


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    runlog.append(runlog.entries(spark, "m", {"depth": 5}, {"auc": 0.5}, "r1", dt.datetime(2024, 1, 1)), path)
    runlog.append(runlog.entries(spark, "m", {"depth": 6}, {"auc": 0.7}, "r2", dt.datetime(2024, 1, 2)), path)
    log = runlog.read(spark, path)
    newest = runlog.latest(log, "m")
    assert newest.first()["run_id"] == "r2"
    assert [tuple(r) for r in runlog.metrics_of(log, newest).collect()] == [("r2", "auc", 0.7)]
