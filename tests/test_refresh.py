"""Refreshes against full recomputation, state by batch against one pass, and plans of the layouts."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from perilframe import fixed_values as V, schema
from perilframe.operators import grids, late_rain, panel_refresh, pyramid, quality, quality_state, rain, sketches
from perilframe.operators.rain import Geometry
from perilframe.plans import jobs
from perilframe.registry import refresh as registered
from perilframe.sources import landed, versions
from perilframe.streaming import closed

GEOMETRY = Geometry(80.0, 26.0, 1.0)


def d(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n - 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_late_pixels_reach_every_table(spark):
    rng = random.Random(4)
    whole = [(x, 0, d(n), float(rng.randrange(9))) for x in range(3) for n in range(1, 60) if n not in (30, 31)]
    late = [p for i, p in enumerate(whole) if p[2] in (d(10), d(11), d(40)) or i % 9 == 0]
    first = [p for p in whole if p not in late and p[:3] != (0, 0, d(50))] + [(0, 0, d(50), 99.0)]
    whole = [p for p in whole if p[:3] != (0, 0, d(50))] + [(0, 0, d(50), None)]
    arrived = [(*p, dt.date(2024, 6, 2)) for p in late if p[:3] != (0, 0, d(50))] + [(0, 0, d(50), None, dt.date(2024, 6, 2))]
    arrived += [(*p[:3], -1.0, dt.date(2024, 6, 1)) for p in late]  # landed before, with another value
    unchanged = [p for p in first if p[2] == d(20)]
    arrived += [(*p, dt.date(2024, 6, 2)) for p in unchanged]
    incidents = [(i, d(rng.randrange(1, 66)), 80.5 + rng.randrange(4), 26.5) for i in range(80)] + [(900, None, 80.5, 26.5), (901, d(5), None, 26.5)]
    samples = spark.createDataFrame(incidents, "incident_id bigint, incident_date date, lon double, lat double")
    grid, target = (spark.createDataFrame(r, schema.RAIN_GRID) for r in (first, whole))
    landing_rows = spark.createDataFrame(arrived, f"{schema.RAIN_GRID}, landed_at date")
    look = lambda g: rain.at_points(samples, g, GEOMETRY, "incident_date", "lon", "lat").select(
        "incident_id", "incident_date", *V.RAIN_ALL)
    stored = look(grid).withColumn("fetched_at", F.lit(None).cast("timestamp"))
    points = spark.createDataFrame([(x, 80.5 + x, 26.5) for x in range(4)], "district_id int, lon double, lat double")
    days = spark.createDataFrame([(d(n),) for n in range(1, 70)], "sample_date date")
    daily = lambda g: rain.daily_rain(points, g, GEOMETRY, days, "district_id")
    by_district = daily(grid).withColumn("ingested_at", F.lit(None).cast("timestamp"))

    new_grid, incident_rain, district_rain, counts = jobs.refresh_late_rain(
        stored, by_district, samples, points, days, grid, landing_rows, GEOMETRY, dt.datetime(2024, 6, 3))
    assert rows_of(new_grid.select(*late_rain.PIXEL, "precip_mm")) == rows_of(target.select(*late_rain.PIXEL, "precip_mm"))
    assert rows_of(incident_rain.drop("fetched_at")) == rows_of(look(target))
    assert rows_of(district_rain.drop("ingested_at")) == rows_of(daily(target))
    # Keys by hand: those whose seven days hold a changed pixel, or a day that had no image.
    was, now = {p[:3]: p[3] for p in first}, {p[:3]: p[3] for p in whole}
    changed = {k for k, v in now.items() if k not in was or was[k] != v}
    opened = {p[2] for p in whole} - {p[2] for p in first}
    keys = {(int(lon - 80), 0, day) for _, day, lon, _ in incidents if day and lon}
    back = lambda day: {day - dt.timedelta(days=n) for n in range(1, 8)}
    touched = {k for k in keys if back(k[2]) & opened or any((k[0], 0, b) in changed for b in back(k[2]))}
    assert (counts["changed_pixels"], counts["opened_days"], counts["incident_keys"]) == (len(changed), len(opened), len(touched))
    assert 0 < len(touched) < len(keys)


def test_a_landing_rewrites_only_its_days(spark, tmp_path):
    path = str(tmp_path / "grid")
    first = [(x, 0, d(n), 1.0) for x in range(3) for n in range(1, 200) if n != 150]
    late_rain.store_grid(spark.createDataFrame(first, schema.RAIN_GRID), path)
    before = versions.manifest(spark, path)
    rows = [(0, 0, d(150), 4.0, 1), (1, 0, d(149), 2.0, 1), (1, 0, d(149), 3.0, 2), (2, 0, d(3), 1.0, 2), (2, 0, d(4), 9.0, None)]
    arrived = spark.createDataFrame(rows, f"{schema.RAIN_GRID}, landed_at int")
    landing = late_rain.land_stored(spark, path, arrived)
    assert rows_of(landing.changed) == rows_of(spark.createDataFrame([(0, 0, d(150), 4.0), (1, 0, d(149), 3.0), (2, 0, d(4), 9.0)], schema.RAIN_GRID))
    assert [r["date"] for r in landing.opened.collect()] == [d(150)]
    want = {(*p[:3],): p[3] for p in first} | {(0, 0, d(150)): 4.0, (1, 0, d(149)): 3.0, (2, 0, d(4)): 9.0}
    assert {(r["cell_x"], r["cell_y"], r["date"]): r["precip_mm"] for r in landing.grid.collect()} == want
    after = versions.manifest(spark, path)
    assert 0 < sum(after.folders[b] != before.folders.get(b) for b in after.folders) <= 3 < len(after.folders)
    plain = late_rain.land(spark.createDataFrame(first, schema.RAIN_GRID), arrived)
    assert rows_of(plain.grid) == rows_of(landing.grid.select(*plain.grid.columns)) and rows_of(plain.opened) == rows_of(landing.opened)


def counts_frame(spark, cells):
    return spark.createDataFrame([(*k, n) for k, n in cells.items()], "district string, hazard string, year int, month int, incident_count bigint")


def test_panel_is_patched(spark):
    rng = random.Random(8)
    cells = {(f"d{i}", f"h{j}", 2015 + m // 12, m % 12 + 1): rng.randrange(1, 9)
             for i in range(6) for j in range(3) for m in range(72) if rng.random() < 0.5}
    state = panel_refresh.build(grids.full_grid(counts_frame(spark, cells)))

    def land(added):
        nonlocal state
        for k, n in added.items():
            cells[k] = cells.get(k, 0) + n
        state, changed = panel_refresh.refresh(state, panel_refresh.deltas(counts_frame(spark, added)))
        whole = panel_refresh.build(grids.full_grid(counts_frame(spark, cells)))
        assert rows_of(state.cells) == rows_of(whole.cells)
        assert rows_of(panel_refresh.panel(state)) == rows_of(grids.panel_features(grids.full_grid(counts_frame(spark, cells))).select(*panel_refresh.FEATURES))
        return changed.count(), whole.cells.count()

    changed, total = land({(f"d{i}", f"h{j}", 2017, 3): 2 for i in range(6) for j in range(3)})
    assert changed < 0.1 * total  # one month: that month of all years, and the next period
    changed, _ = land({("d1", "h1", 2018, 12): 1})
    assert changed <= 6 + 2
    land({("d1", "h1", 2021, 2): 4, ("d2", "h0", 2014, 7): 1})  # periods after and before all others
    land({("d9", "h1", 2016, 5): 3, ("d0", "h7", 2016, 5): 2, ("d9", "h7", 2022, 1): 1})  # a new district and a new hazard
    assert land({})[0] == 0


def check_rows(spark, seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(40 * seed, 40 * seed + 30), 3]), rng.choice([None, 5, 99]), rng.choice([None, 1, 0])) for _ in range(n)]
    return spark.createDataFrame(rows, "id bigint, hazard_id int, loss_id int")


RULES = lambda: [quality.not_null("id"), quality.unique("id"), quality.in_set("hazard_id", range(1, 48)), quality.between("loss_id", low=1, mostly=0.4)]


def test_checks_by_batch(spark, tmp_path, monkeypatch):
    batches, path = [check_rows(spark, i, 60) for i in (0, 1, 2)], str(tmp_path / "state")
    quality_state.start(batches[0], path, RULES(), 8)
    quality_state.add(batches[0], path, RULES(), 0)
    with monkeypatch.context() as m:  # dies after the counts were published, before the keys were
        merge, done = versions.merge, []

        def first_only(*args, **kwargs):
            if done:
                raise OSError("gone")
            done.append(1)
            return merge(*args, **kwargs)

        m.setattr(versions, "merge", first_only)
        with pytest.raises(OSError):
            quality_state.add(batches[1], path, RULES(), 1)
    quality_state.add(batches[1], path, RULES(), 1)
    quality_state.add(batches[1], path, RULES(), 1)
    quality_state.add(batches[2], path, RULES(), 2)
    whole = batches[0].unionByName(batches[1]).unionByName(batches[2])
    assert rows_of(quality_state.report(spark, path)) == rows_of(quality.report(whole, RULES()))
    # A batch of one key reads the one bucket it is in.
    one = spark.createDataFrame([(3,)], "key bigint")
    read = versions.read_buckets_of(spark, f"{path}/keys-id", one)
    assert 0 < len({f for f in read.inputFiles()}) < len(versions.read(spark, f"{path}/keys-id").inputFiles())


def test_sketches_merge_over_days_and_landings(spark):
    rng = random.Random(2)
    rows = [(d(1 + i % 10), rng.gauss(0, 5), i % 700) for i in range(6000)] + [(d(1), None, None), (None, 1.0, 3)]
    df = spark.createDataFrame(rows, "day date, v double, k int")
    make = lambda part: sketches.daily(part, "day", ["v"], ["k"])
    held = sketches.added(make(df.where("k % 3 > 0")), make(df.where("k % 3 = 0 or k is null")), "day")
    assert {r["day"]: r["n"] for r in held.collect()} == {r["day"]: r["count"] for r in df.groupBy("day").count().collect()}
    values = sorted(v for _, v, _ in rows if v is not None)
    for r in sketches.quantiles(held, "v", [0.1, 0.5, 0.9]).collect():
        assert abs(sum(v <= r["value"] for v in values) / len(values) - r["p"]) <= sketches.RANK_ERROR
    assert abs(sketches.distinct(held, "k").first()[0] - 700) <= 700 * sketches.DISTINCT_ERROR
    some = {r["day"]: r["estimate"] for r in sketches.distinct(held, "k", ["day"]).collect()}
    assert abs(some[d(2)] - 70) <= 4


def test_bucketed_grid_is_not_shuffled(spark, sf):
    """No Exchange above the grid's scan in the join, also where the grid is too large to broadcast."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        name, found = registered.bucketed_lookup(spark, sf)
        plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    depth = lambda line: len(re.match(r"[\s:|+\-]*", line).group())
    scans = [i for i, line in enumerate(plan) if "FileScan" in line and "precip_mm" in line]
    assert len(scans) == 1 and "Bucketed: true" in plan[scans[0]] and "year" in plan[scans[0]]
    above, level = [], depth(plan[scans[0]])
    for line in reversed(plan[: scans[0]]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
        if "Join" in line and depth(line) == level:
            break
    assert "Join" in above[-1] and not any("Exchange" in line for line in above), above


def test_variant_paths(spark):
    rows = [('{"loss":5}',), ('{"loss":{"id":7,"deaths":2}}',), ('{"loss":null}',), ("{}",), ("no json",), (None,), ('{"loss":{"id":"zz"}}',), ('{"loss":"12"}',)]
    stored = landed.with_variant(spark.createDataFrame(rows, "record string"))
    got = [tuple(r) for r in stored.select(landed.variant_id("loss"), landed.from_variant("$.loss.deaths", "int")).collect()]
    assert got == [(5, None), (7, 2), (None, None), (None, None), (None, None), (None, None), (None, None), (12, None)]


def test_pyramid_levels_and_views(spark):
    rng = random.Random(6)
    points = [(i, rng.uniform(80, 88), rng.uniform(26, 30)) for i in range(400)] + [(900, 180.0, 90.0), (901, -180.0, -90.0), (902, 85.0, 28.0), (903, 85.0, 28.0)]
    levels = pyramid.pyramid(spark.createDataFrame(points, "id int, longitude double, latitude double"), 10)
    for zoom, level in zip(range(10, -1, -1), levels):
        side, want = 1 << zoom, {}
        for i, lon, lat in points:
            x, y = (min(side - 1, int((v - low) / span * side)) for v, low, span in ((lon, -180, 360), (lat, -90, 180)))
            key = sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(zoom))
            want.setdefault(key, []).append((i, x, y))
        got = {r["key"]: (r["points"], r["first_id"]) for r in level.collect()}
        assert got == {k: (len(v), min(v)[0]) for k, v in want.items()}
        box = (82.0, 27.0, 85.0, 29.0)
        inside = {r["key"] for r in pyramid.in_view(level, zoom, *box).collect()}
        edges = [int((v - low) / span * side) for v, low, span in zip(box, (-180, -90, -180, -90), (360, 180, 360, 180))]
        assert inside == {k for k, v in want.items() if edges[0] <= v[0][1] <= edges[2] and edges[1] <= v[0][2] <= edges[3]}


def test_months_close_once(spark, tmp_path):
    src, out, first, second = (str(tmp_path / n) for n in ("src", "out", "first", "second"))
    ddl = "at timestamp, kind string, value double"

    def land(*rows):
        made = spark.createDataFrame([(dt.datetime(2024, m, day), k, v) for m, day, k, v in rows], ddl)
        made.coalesce(1).write.mode("append").parquet(src)
        run()

    def run():
        closed.start_intake(spark.readStream.schema(ddl).parquet(src), out, first, "at", "kind", "value").awaitTermination()
        closed.start_closing(spark, out, second).awaitTermination()

    land((1, 5, "a", 1.0), (1, 20, "b", 2.0), (2, 1, "a", 4.0))
    land((2, 9, "a", 8.0), (1, 9, "a", 16.0))  # January is late but still open
    land((3, 31, "a", 32.0))
    land((1, 31, "a", 64.0), (4, 1, "b", 128.0))  # January has closed
    for name in ("3", ".3.crc"):
        (tmp_path / "first" / "commits" / name).unlink(missing_ok=True)
    run()  # the last batch again
    land((6, 1, "a", 256.0), (2, 2, "a", 512.0))
    emitted = closed.read(spark, out, "closed").groupBy("month", "kind").count().collect()
    assert emitted and all(r["count"] == 1 for r in emitted)
    assert (dt.datetime(2024, 1, 1), "a") in {(r["month"], r["kind"]) for r in emitted}
    got = {(r["month"].month, r["kind"]): (r["n"], r["total"], r["late"]) for r in closed.totals(spark, out).collect()}
    assert got == {(1, "a"): (3, 81.0, 1), (1, "b"): (1, 2.0, 0), (2, "a"): (3, 524.0, 1), (3, "a"): (1, 32.0, 0),
                   (4, "b"): (1, 128.0, 0), (6, "a"): (1, 256.0, 0)}
    assert closed.totals(spark, out).where("month = '2024-06-01'").first()["closed"] is False
