import datetime as dt
import json

from pyspark.sql import functions as F

from perilframe import schema
from perilframe.operators.rain import Geometry
from perilframe.plans import jobs


def test_daily_intake_checks_what_it_stored(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    reports = [
        {"id": 1, "hazard": 17, "incidentOn": "2026-07-14T00:00:00+00:00", "dataSource": "drr_api", "loss": 5,
         "point": {"coordinates": [82.6, 28.3]}, "modifiedOn": "2026-07-14T00:00:00+00:00"},
        {"id": 2, "hazard": {"id": 99}, "incidentOn": "2026-07-01T00:00:00+00:00", "dataSource": "drr_api", "loss": {"id": 0}},
        {"title": "no id"},
    ]
    (landing / "a.json").write_text("\n".join(map(json.dumps, reports)))
    paths = [str(tmp_path / n) for n in ("log", "progress", "rejects")]
    incidents, recent, report = jobs.daily_intake(spark, str(landing), *paths, dt.datetime(2026, 7, 15))
    assert incidents.count() == 2 and [r["id"] for r in recent.collect()] == [1]
    failed = {r["rule"] for r in report.collect() if not r["success"]}
    assert failed == {"in_set(hazard_id)", "between(loss_id)"}
    assert spark.read.parquet(paths[2]).count() == 1


def test_update_district_rain_rewrites_target_days(spark):
    d = lambda n: dt.date(2024, 1, n)
    stored = spark.createDataFrame([(1, d(3), None, None, None, None, None), (1, d(9), None, None, None, None, None)], schema.DISTRICT_DAILY_RAIN)
    samples = spark.createDataFrame([(5, 1, 80.5, 26.5), (9, 1, 95.0, 26.5), (6, 2, 81.5, 26.5)], "id int, district_id int, lon double, lat double")
    grid = spark.createDataFrame([(x, 0, d(n), float(n + x)) for x in range(2) for n in (1, 2)], schema.RAIN_GRID)
    days = spark.createDataFrame([(d(3),), (d(20),)], "sample_date date")
    at = dt.datetime(2024, 1, 21)
    done = jobs.update_district_rain(stored, samples, grid, Geometry(80.0, 26.0, 1.0), days, at)
    got = {(r["district_id"], r["sample_date"].day): (r["rain_1d"], r["rain_7d"], r["ingested_at"]) for r in done.collect()}
    assert got == {(1, 3): (2, 3, at), (1, 9): (None, None, None), (2, 3): (3, 5, at)}
    assert done.schema["rain_1d"].dataType.simpleString() == "decimal(10,4)"


def test_scratch_of_a_finished_job_is_deleted(spark):
    import os

    from perilframe.session import owned_scratch, shared_folder, stable

    folder = shared_folder(spark).removeprefix("file:")
    kept = stable(spark.range(3))
    before = set(os.listdir(folder))
    with owned_scratch(spark):
        assert stable(spark.range(5)).count() == 5
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before and kept.count() == 3
