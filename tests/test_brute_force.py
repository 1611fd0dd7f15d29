"""Operators against plain loops on random data."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilframe import fixed_values as V
from perilframe.operators import encode, grids, rain, splits, upsert as writes
from perilframe.plans import models


@pytest.mark.parametrize("seed", range(3))
def test_upsert_equals_row_at_a_time(spark, seed):
    rng = random.Random(seed)
    row = lambda i, seq: (i, rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2]), seq)
    stored = [row(i, 0) for i in range(0, 40, 2)]
    batch = [row(7 if rng.random() < 0.33 else rng.randrange(50), n) for n in range(1, 200)]
    table = {r[0]: list(r[1:3]) for r in stored}
    for i, title, kept, _ in batch:
        if i in table:
            table[i][0] = title
        else:
            table[i] = [title, kept]
    ddl = "id int, title string, hazard_id int, seq int"
    done = writes.upsert(
        spark.createDataFrame(stored, ddl), spark.createDataFrame(batch, ddl).repartition(5), ["id"], ["title"], order="seq"
    )
    assert {r["id"]: [r["title"], r["hazard_id"]] for r in done.collect()} == table


@pytest.mark.parametrize("gate", [1, 7])
def test_rain_at_points_equals_loops(spark, gate):
    rng = random.Random(gate)
    d0 = dt.date(2024, 1, 1)
    days = [d0 + dt.timedelta(days=i) for i in range(60) if rng.random() < 0.6]
    cells = {(x, y, d): (None if rng.random() < 0.1 else float(rng.randrange(20))) for x in range(3) for y in range(2) for d in days if rng.random() < 0.9}
    samples = [(i, d0 + dt.timedelta(days=20 if i % 3 == 0 else rng.randrange(70)), rng.random() * 3, rng.random() * 2) for i in range(300)]
    images = {d for (_, _, d) in cells}
    expected = {}
    for i, d, lon, lat in samples:
        if not any(d - dt.timedelta(days=k) in images for k in range(1, gate + 1)):
            continue
        past = lambda n: [v for k in range(1, n + 1) if (v := cells.get((int(lon), int(lat), d - dt.timedelta(days=k)))) is not None]  # noqa: E731,B023
        expected[i] = tuple(sum(past(n)) if past(n) else None for n in (1, 3, 7)) + (max(past(7)) if past(7) else None,)
    got = rain.at_points(
        spark.createDataFrame(samples, "id int, d date, lon double, lat double"),
        spark.createDataFrame([(*k, v) for k, v in cells.items()], "cell_x int, cell_y int, date date, precip_mm double"),
        rain.Geometry(0.0, 0.0, 1.0), "d", "lon", "lat", gate,
    ).collect()
    assert {r["id"]: tuple(r[c] for c in V.RAIN_ALL) for r in got} == expected


def test_panel_equals_loops(spark):
    rng = random.Random(5)
    at = [dt.datetime(2022, 1, 1) + dt.timedelta(days=rng.randrange(900)) for _ in range(400)]
    rows = [(i % 3, i % 2, t) for i, t in enumerate(at)]
    dim = lambda n, p: spark.createDataFrame([(i, f"{p}{i}") for i in range(n)], "id int, title string")
    counts = grids.monthly_counts(spark.createDataFrame(rows, "district_id int, hazard_id int, incident_on timestamp"), dim(3, "d"), dim(2, "h"))
    n = {}
    for d, h, t in rows:
        n[(d, h, t.year, t.month)] = n.get((d, h, t.year, t.month), 0) + 1
    periods = sorted({k[2:] for k in n})
    expected = {}
    for d in range(3):
        for h in range(2):
            series = [n.get((d, h, *p), 0) for p in periods]
            for k in range(1, len(periods)):
                same = [c for c, p in zip(series, periods) if p[1] == periods[k][1]]
                expected[(f"d{d}", f"h{h}", *periods[k])] = (series[k], series[k - 1], round(sum(same) / len(same), 9))
    got = grids.panel_features(grids.full_grid(counts)).collect()
    assert {(r["district"], r["hazard"], r["year"], r["month"]): (r["incident_count"], r["prev_month_count"], round(r["historical_month_avg"], 9)) for r in got} == expected


def test_balanced_logistic_regression_has_the_unit_penalty(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        a, b, c = rng.random() * 10, rng.random() * 3, rng.random()
        rows.append((i, a, b, c, int(rng.random() < 1 / (1 + np.exp(2.5 - 0.4 * a)))))
    data = spark.createDataFrame(rows, "row_id bigint, rain_1d double, rain_3d double, rain_7d double, label int")
    run = models.fit_logistic("r", data, rain=True, district=False)
    train, _ = splits.halves(splits.mark_stratified(data, "label", "row_id"))
    pdf = encode.apply_scale(train, encode.fit_scale(train, V.RAIN_SUMS)).toPandas()
    x, y = pdf[[f"{c}_scaled" for c in V.RAIN_SUMS]].to_numpy(), pdf["label"].to_numpy()
    fitted = run.model.stages[-1]
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    p = 1 / (1 + np.exp(-(x @ fitted.coefficients.toArray() + fitted.intercept)))
    gradient = x.T @ (w * (p - y)) + fitted.coefficients.toArray()
    assert np.abs(gradient).max() < 0.02 < 0.5 < np.abs(fitted.coefficients.toArray()).max()
    assert abs((w * (p - y)).sum()) < 0.02
