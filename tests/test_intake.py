import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from perilframe import schema
from perilframe.operators import upsert as writes
from perilframe.sources import landed, tables


def records(spark, *objects):
    return spark.createDataFrame([(json.dumps(o) if not isinstance(o, str) else o,) for o in objects], "record string")


@pytest.mark.parametrize(
    "loss,expected",
    [(None, None), (70112, 70112), ({"id": 70112, "peopleInjuredCount": 4}, 70112), ({"peopleInjuredCount": 4}, None)],
)
def test_loss_id(spark, loss, expected):
    assert landed.flatten(records(spark, {"id": 1, "loss": loss})).first()["loss_id"] == expected


def test_loss_id_absent(spark):
    assert landed.flatten(records(spark, {"id": 1})).first()["loss_id"] is None


@pytest.mark.parametrize("hazard,expected", [(23, 23), ({"id": 23, "title": "Hailstorm"}, 23), (None, None)])
def test_hazard_id(spark, hazard, expected):
    assert landed.flatten(records(spark, {"id": 1, "hazard": hazard})).first()["hazard_id"] == expected


@pytest.mark.parametrize("point", [None, {}, {"coordinates": None}, {"coordinates": []}])
def test_point_missing(spark, point):
    row = landed.flatten(records(spark, {"id": 1, "point": point})).first()
    assert row["lon"] is None and row["lat"] is None


def test_flatten_keeps_the_whole_record(spark):
    report = {"id": 5, "titleNe": "x", "incidentOn": "2026-07-15T05:45:00+05:45", "extra": {"deep": [1, 2]},
              "point": {"coordinates": [82.6, 28.3]}, "verified": True}
    row = landed.flatten(records(spark, report)).first()
    assert (row["id"], row["title_ne"], row["lon"], row["lat"], row["verified"]) == (5, "x", 82.6, 28.3, True)
    assert row["incident_on"] == dt.datetime(2026, 7, 15)
    assert json.loads(row["raw_data"]) == report


def pages(spark, *bodies):
    return spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies, 1)], "page bigint, body string")


def ids(df):
    return sorted(int(json.loads(r["record"])["id"]) for r in df.collect())


def test_pages_stop_before_first_empty_page(spark):
    got = landed.page_records(pages(
        spark, {"results": [{"id": 41}, {"id": 58}, {"id": 60}], "next": "b"}, {"results": [{"id": 77}], "next": "c"},
        {"results": [], "next": "d"}, {"results": [{"id": 90}], "next": "e"},
    ))
    assert ids(got) == [41, 58, 60, 77]


def test_pages_stop_after_missing_next(spark):
    got = landed.page_records(pages(spark, {"results": [{"id": 1}], "next": None}, {"results": [{"id": 2}], "next": None}))
    assert ids(got) == [1]


def test_page_without_results_is_empty(spark):
    assert ids(landed.page_records(pages(spark, {"results": [{"id": 1}], "next": "x"}, {"next": "y"}))) == [1]


def test_all_pages_full(spark):
    assert ids(landed.page_records(pages(spark, {"results": [{"id": 1}], "next": "x"}, {"results": [{"id": 2}], "next": "y"}))) == [1, 2]


def test_read_pages_from_files(spark, tmp_path):
    for n, body in [(1, {"results": [{"id": 1, "loss": {"id": 4}}], "next": "p2"}), (2, {"results": [{"id": 2, "loss": 7}], "next": None})]:
        (tmp_path / f"page-{n:04d}.json").write_text(json.dumps(body))
    rows = landed.flatten(landed.page_records(landed.read_pages(spark, str(tmp_path)))).orderBy("id").collect()
    assert [(r["id"], r["loss_id"]) for r in rows] == [(1, 4), (2, 7)]


def test_rejects_keep_good_neighbours(spark):
    rows = records(spark, {"id": 1}, {"title": "x"}, {"id": "abc"}, "not json", {"id": 2, "incidentOn": "soon"}, {"id": 3, "verified": "maybe"})
    good, bad = landed.split_rejects(rows)
    assert ids(good) == [1]
    assert sorted(r["reason"] for r in bad.collect()) == ["bad id", "bad incidentOn", "bad verified", "no id", "no id"]


def test_trailing_window_is_strict(spark):
    as_of = dt.datetime(2026, 1, 10)
    rows = spark.createDataFrame(
        [(1, as_of, "drr_api"), (2, as_of - dt.timedelta(days=3), "drr_api"), (3, as_of - dt.timedelta(days=2), "drr_api"),
         (4, as_of - dt.timedelta(days=2), "other")], "id int, incident_on timestamp, data_source string")
    assert [r["id"] for r in landed.trailing_window(rows, as_of, 3).collect()] == [3]


T = "id int, title string, verified boolean, hazard_id int, seq int"


def test_upsert_partial_columns(spark):
    stored = spark.createDataFrame([(1, "old", True, 17, 0), (3, "kept", False, 5, 0)], T)
    batch = spark.createDataFrame([(1, "new", None, 99, 1), (2, "first", True, 7, 1), (2, "second", None, 8, 2)], T)
    done = writes.upsert(stored, batch, ["id"], ["title", "verified"], order="seq")
    got = {r["id"]: (r["title"], r["verified"], r["hazard_id"]) for r in done.collect()}
    assert got == {1: ("new", None, 17), 2: ("second", None, 7), 3: ("kept", False, 5)}


def test_upsert_twice_changes_nothing(spark):
    stored = spark.createDataFrame([(1, "old", True, 17, 0)], T)
    batch = spark.createDataFrame([(1, "new", None, 99, 1), (2, "b", True, 7, 1)], T)
    once = writes.upsert(stored, batch, ["id"], ["title", "verified"], order="seq")
    twice = writes.upsert(once, batch, ["id"], ["title", "verified"], order="seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_upsert_does_not_shuffle_the_stored_table_for_a_small_batch(spark):
    stored = spark.range(0, 200_000).selectExpr("id", "cast(id as string) as title", "id as seq")
    batch = spark.createDataFrame([(1, "x", 1), (300_000, "y", 1)], "id bigint, title string, seq bigint")
    done = writes.upsert(stored, batch, ["id"], ["title"], order="seq")
    assert done.count() == 200_001
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_rain_upsert_keeps_peak(spark):
    cols = "incident_id bigint, rain_1d double, rain_3d double, rain_7d double, rain_peak_7d double, fetched_at int"
    stored = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 9.0, 0)], cols)
    batch = spark.createDataFrame([(1, 2.0, 2.0, 2.0, None, 1)], cols)
    row = writes.upsert(stored, batch, *schema.UPSERT_RULES["incident_rain"]).first()
    assert (row["rain_1d"], row["rain_peak_7d"], row["fetched_at"]) == (2.0, 9.0, 1)


def test_update_only_drops_unmatched_and_writes_null(spark):
    target = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "id int, v double")
    source = spark.createDataFrame([(1, None), (2, 8.0), (9, 1.0)], "id int, v double")
    done = writes.update_only(target, source, ["id"], ["v"])
    assert sorted(map(tuple, done.collect())) == [(1, None), (2, 8.0), (3, 7.0)]


def test_lookup_records_read_their_own_spelling(spark):
    h = landed.flatten_hazards(records(spark, {"id": 1, "title": "t", "titleNe": "n", "icon": "i"})).first()
    d = landed.flatten_districts(records(spark, {"id": 1, "title": "t", "title_ne": "n", "province": 3})).first()
    m = landed.flatten_municipalities(records(spark, {"id": 1, "title": "t", "title_ne": "n", "district": 4})).first()
    assert (h["title_ne"], h["icon_url"], d["title_ne"], d["province_id"], m["district_id"]) == ("n", "i", "n", 3, 4)


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "panel")
    rows = [("Rolpa", "Fire", 2024, 7, 0, 3, 1.5), ("Rolpa", "Flood, flash", 2024, 8, 2, 0, None)]
    df = spark.createDataFrame(rows, schema.PANEL)
    tables.write_csv(df, path)
    back = tables.read_csv(spark, path, schema.PANEL)
    assert back.schema == df.schema
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_rain_grid_reads_only_its_days(spark, tmp_path):
    path = str(tmp_path / "grid")
    start = dt.date(2024, 1, 1)
    grid = spark.createDataFrame([(x, 0, start + dt.timedelta(days=i), 1.0) for i in range(10) for x in range(3)], schema.RAIN_GRID)
    tables.write_rain_grid(grid, path)
    part = tables.read_rain_grid(spark, path, dt.date(2024, 1, 3), dt.date(2024, 1, 5))
    assert part.count() == 6
    assert "PartitionFilters: [isnotnull(date" in part._jdf.queryExecution().executedPlan().toString()


def test_a_truncated_page_costs_only_itself(spark):
    bodies = [json.dumps({"results": [{"id": i}], "next": "more"}) for i in range(1, 5)]
    bodies[1] = bodies[1][:-4]
    made = spark.createDataFrame(list(enumerate(bodies, 1)), "page bigint, body string")
    assert ids(landed.page_records(made)) == [1, 3, 4]
    assert [(r["page"], r["body"]) for r in landed.page_rejects(made).collect()] == [(2, bodies[1])]
    assert [(r["page"], r["at"]) for r in landed.page_records(made).orderBy("page").collect()] == [(1, 0), (3, 0), (4, 0)]


def test_repeated_keys_without_an_order_keep_the_last_arrival(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "id int, title string, type string")
    rows = [(1, "c", "y"), (1, "d", "z"), (9, "e", "first"), (9, "f", "second"), (None, "g", "h")]
    batch = spark.createDataFrame(rows, stored.schema)
    numbered = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id int, title string, type string, arrival int")
    done = writes.upsert(stored, numbered.repartition(3), ["id"], ["title"])
    assert sorted(map(tuple, done.collect())) == [(1, "d", "x"), (2, "b", "x"), (9, "f", "first")]
    assert [r["title"] for r in writes.unkeyed(batch, ["id"]).collect()] == ["g"]
    arrived = batch.where("id = 9").withColumn("arrival", F.when(F.col("title") == "e", 2).otherwise(1))
    assert writes.upsert(stored, arrived, ["id"], ["title"]).where("id = 9").first()["title"] == "e"


def test_a_row_without_an_order_value_is_the_oldest(spark):
    stored = spark.createDataFrame([(1, "a", 1)], "id int, title string, seq int")
    batch = spark.createDataFrame([(1, "b", None), (2, "c", None), (3, "new", 5), (3, "old", None)], stored.schema)
    done = writes.upsert(stored, batch, ["id"], ["title", "seq"], order="seq")
    assert sorted(map(tuple, done.collect()), key=lambda r: r[0]) == [(1, "b", None), (2, "c", None), (3, "new", 5)]


@pytest.mark.parametrize("field, value, reason", [
    ("hazard", "abc", "bad hazard"), ("hazard", 99999999999, "bad hazard"), ("hazard", {"title": "x"}, None), ("hazard", 17, None),
    ("loss", {"id": "zz"}, "bad loss"), ("loss", {"deaths": 0}, None), ("point", "nope", "bad point"), ("point", {}, None),
    ("point", {"coordinates": ["a", "b"]}, "bad point"), ("point", {"coordinates": [82.6]}, "bad point"),
    ("point", {"coordinates": []}, None), ("point", {"coordinates": None}, None), ("point", {"coordinates": [82.6, 28.3]}, None),
])
def test_values_that_do_not_convert_are_rejected(spark, field, value, reason):
    assert landed.with_reason(records(spark, {"id": 1, field: value})).first()["reason"] == reason
