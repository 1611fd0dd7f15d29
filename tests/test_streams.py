import json

import pytest
from pyspark.sql import functions as F

from perilframe import schema
from perilframe.operators.upsert import upsert
from perilframe.sources import versions
from perilframe.streaming import counts, folded, intake


def land(folder, name, *objects):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(o if isinstance(o, str) else json.dumps(o) for o in objects))


def state(spark, log):
    return {r["id"]: (r["title"], r["hazard_id"], r["verified"]) for r in intake.current(intake.read_log(spark, log)).collect()}


def test_intake_folds_rejects_and_replays(spark, tmp_path):
    landing, log, progress, bad = (tmp_path / n for n in ("landing", "log", "progress", "bad"))

    def run():
        intake.start(spark, str(landing), str(log), str(progress), str(bad)).awaitTermination()

    land(landing, "a.json", {"id": 1, "title": "one", "hazard": 17, "verified": True, "modifiedOn": "2024-01-01T00:00:00+00:00"},
         {"id": 2, "title": "late", "hazard": 3, "modifiedOn": "2024-01-03T00:00:00+00:00"},
         {"id": 2, "title": "early", "hazard": 4, "modifiedOn": "2024-01-02T00:00:00+00:00"}, "garbage")
    run()
    assert state(spark, str(log)) == {1: ("one", 17, True), 2: ("late", 4, None)}
    run()  # nothing new
    land(landing, "b.json", {"id": 1, "title": "uno", "hazard": 99, "modifiedOn": "2024-02-01T00:00:00+00:00"})
    run()
    expected = {1: ("uno", 17, None), 2: ("late", 4, None)}
    assert state(spark, str(log)) == expected
    assert [r["reason"] for r in spark.read.parquet(str(bad)).collect()] == ["no id"]
    # A batch replayed after a crash replaces its own folder.
    batch = spark.read.text(str(landing / "b.json"))
    intake._write_batch(str(log), None)(batch, 1)
    assert state(spark, str(log)) == expected
    assert intake.compact(spark, str(log), str(progress)) == 1
    assert intake.read_log(spark, str(log)).count() == 2
    assert state(spark, str(log)) == expected


def test_intake_collapses_only_repeated_keys(spark, tmp_path, monkeypatch):
    """A report whose key stands once in its batch is written as it is; the current table can be asked for some of its columns."""
    seen, whole = [], intake.collapse

    def collapse(batch, *args):
        seen.append(sorted(r["id"] for r in batch.select("id").collect()))
        return whole(batch, *args)

    monkeypatch.setattr(intake, "collapse", collapse)
    log, title = str(tmp_path / "log"), lambda t, day: {"title": t, "hazard": 5, "modifiedOn": f"2024-01-0{day}T00:00:00+00:00"}
    land(tmp_path / "a", "a.json", {"id": 1, **title("one", 1)}, {"id": 2, **title("new", 3)}, {"id": 2, **title("old", 2)}, {"id": 3, "verified": True})
    land(tmp_path / "b", "b.json", {"id": 3, **title("three", 4)}, {"id": 4, **title("four", 4)})
    for i, name in enumerate(("a/a.json", "b/b.json")):
        intake._write_batch(log, None)(spark.read.text(str(tmp_path / name)), i)
    assert seen == [[2, 2], []]
    rows = intake.read_log(spark, log)
    full = intake.current(rows)
    assert {r["id"]: (r["title"], r["hazard_id"], r["verified"]) for r in full.collect()} == {
        1: ("one", 5, None), 2: ("new", 5, None), 3: ("three", None, None), 4: ("four", 5, None)}
    few = intake.current(rows, columns=["verified", "id", "hazard_id", "modified_on"])
    assert few.columns == ["verified", "id", "hazard_id", "modified_on"]
    assert sorted(map(str, few.collect())) == sorted(map(str, full.select(few.columns).collect()))
    plan = few._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "raw_data" in line and "Relation [" not in line]


def test_daily_counts_across_batches(spark, tmp_path):
    src, out, progress = (str(tmp_path / n) for n in ("src", "out", "progress"))
    ddl = "ts timestamp, kind string, value double"

    def add(*rows):
        spark.createDataFrame([(t, k, v) for t, k, v in rows], "ts string, kind string, value double").select(
            F.col("ts").cast("timestamp").alias("ts"), "kind", "value").coalesce(1).write.mode("append").parquet(src)
        events = spark.readStream.schema(ddl).parquet(src)
        counts.start_daily(events, out, progress, "ts", "kind", "value").awaitTermination()

    add(("2024-01-01 01:00:00", "a", 1.0), ("2024-01-02 01:00:00", "a", 1.0))
    add(("2024-01-01 23:00:00", "a", 2.0), ("2024-01-01 05:00:00", "b", 5.0))
    got = {(r["day"].day, r["kind"]): (r["n"], r["total"]) for r in counts.latest(spark, out).collect()}
    assert got == {(1, "a"): (2, 3.0), (2, "a"): (1, 1.0), (1, "b"): (1, 5.0)}
    add(("2023-07-01 12:00:00", "a", 4.0))  # half a year late
    late = {(r["day"].month, r["n"], r["total"]) for r in counts.latest(spark, out).where("day < '2024-01-01'").collect()}
    assert late == {(7, 1, 4.0)}
    whole = sorted(map(tuple, counts.latest(spark, out).collect()))
    assert counts.compact(spark, out, progress) == 2
    assert counts.read_log(spark, out).select("batch_id").distinct().count() == 1
    assert sorted(map(tuple, counts.latest(spark, out).collect())) == whole


def uncommit(progress, number):
    """The stream as it stands if it died after batch `number` was written and before it was committed."""
    for name in (str(number), f".{number}.crc"):
        (progress / "commits" / name).unlink(missing_ok=True)


def test_compaction_survives_a_replayed_count(spark, tmp_path):
    src, out, progress = (str(tmp_path / n) for n in ("src", "out", "progress"))
    ddl = "ts timestamp, kind string, value double"

    def run():
        counts.start_daily(spark.readStream.schema(ddl).parquet(src), out, progress, "ts", "kind", "value").awaitTermination()
        return sum(r["n"] for r in counts.latest(spark, out).collect())

    for day in (1, 2):
        rows = [(f"2024-01-0{day} 01:00:00", "a", 1.0)] * 10
        spark.createDataFrame(rows, "ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(
            1).write.mode("append").parquet(src)
        assert run() == 10 * day
    uncommit(tmp_path / "progress", 1)
    assert counts.compact(spark, out, progress) == 0
    assert sum(r["n"] for r in counts.latest(spark, out).collect()) == 20
    assert run() == 20  # batch 1 runs again
    assert counts.compact(spark, out, progress) == 1
    assert folded.drop_folded(spark, out) == 1  # batch 0, which the base before holds
    assert sum(r["n"] for r in counts.latest(spark, out).collect()) == 20 and run() == 20


def report(i, day, title="t"):
    return {"id": i, "title": f"{title}{i}", "hazard": 17, "modifiedOn": f"2024-01-0{day}T00:00:00+00:00"}


def test_compaction_survives_a_replayed_intake(spark, tmp_path):
    landing, log, progress = (tmp_path / n for n in ("landing", "log", "progress"))
    for day, ids in ((1, range(10)), (2, range(5, 15))):
        land(landing, f"{day}.json", *[report(i, day, f"d{day} ") for i in ids])
        intake.start(spark, str(landing), str(log), str(progress)).awaitTermination()
    want = {i: ("d1 " if i < 5 else "d2 ") + str(i) for i in range(15)}
    uncommit(progress, 1)
    assert intake.compact(spark, str(log), str(progress)) == 0
    assert {k: v[0] for k, v in state(spark, str(log)).items()} == want
    intake.start(spark, str(landing), str(log), str(progress)).awaitTermination()
    assert {k: v[0] for k, v in state(spark, str(log)).items()} == want
    assert intake.compact(spark, str(log), str(progress)) == 1
    assert {k: v[0] for k, v in state(spark, str(log)).items()} == want


def test_intake_into_a_versioned_table_is_replayed_once(spark, tmp_path):
    landing, store, progress = tmp_path / "landing", str(tmp_path / "store"), tmp_path / "progress"
    versions.create(spark.createDataFrame([], schema.INCIDENTS), store, ["id"], versions.by_hash(["id"], 4))
    for day, ids in ((1, range(10)), (2, range(5, 15))):
        land(landing, f"{day}.json", *[report(i, day, f"d{day} ") for i in ids])
        intake.start_store(spark, str(landing), store, str(progress)).awaitTermination()
    titles = lambda: {r["id"]: r["title"] for r in versions.read(spark, store).collect()}
    want = {i: ("d1 " if i < 5 else "d2 ") + str(i) for i in range(15)}
    assert titles() == want and versions.versions(spark, store) == [0, 1, 2]
    uncommit(progress, 1)
    intake.start_store(spark, str(landing), store, str(progress)).awaitTermination()
    assert titles() == want and versions.versions(spark, store) == [0, 1, 2]


def test_a_write_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    ddl = "id long, title string, first string"
    versions.create(spark.createDataFrame([(i, f"a{i}", "x") for i in range(20)], ddl), store, ["id"], versions.by_hash(["id"], 8))
    before = sorted(map(tuple, versions.read(spark, store).collect()))
    batch = spark.createDataFrame([(3, "b3", "y"), (99, "b99", "y")], ddl)

    def dies(*_):
        raise OSError("the writer is gone")

    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", dies)
        with pytest.raises(OSError):
            versions.merge(spark, store, batch, ["title"])
    assert sorted(map(tuple, versions.read(spark, store).collect())) == before
    old = versions.manifest(spark, store)
    assert versions.merge(spark, store, batch, ["title"]) == 1
    new = versions.manifest(spark, store)
    assert sum(old.folders.get(b) != f for b, f in new.folders.items()) <= 2  # only the buckets of 3 and 99
    want = sorted([(i, "b3" if i == 3 else f"a{i}", "x") for i in range(20)] + [(99, "b99", "y")])
    assert sorted(map(tuple, versions.read(spark, store).collect())) == want
    assert sorted(map(tuple, versions.read(spark, store, 0).collect())) == before
    # A second writer that started from the same version does not win over the first.
    with pytest.raises(versions.Conflict):
        versions._publish(spark, store, new)
    assert versions.patch(spark, store, spark.createDataFrame([(5, "p5", "z")], ddl), spark.createDataFrame([(7, "", ""), (8, "", "")], ddl)) == 2
    told = {r["id"]: r["title"] for r in versions.read(spark, store).collect()}
    assert 7 not in told and 8 not in told and told[5] == "p5" and len(told) == 19
    assert versions.vacuum(spark, store, keep=1, older_than_s=-60) >= 1
    assert versions.versions(spark, store) == [2] and versions.read(spark, store).count() == 19


def test_batches_without_an_order_are_not_guessed(spark):
    ddl = "id long, title string"
    stored = spark.createDataFrame([(1, "a")], ddl)
    twice = spark.createDataFrame([(1, "b"), (1, "c")], ddl)
    with pytest.raises(Exception, match="differ, and there is no order"):
        upsert(stored, twice, ["id"], ["title"]).collect()
    same = spark.createDataFrame([(1, "b"), (1, "b"), (2, "n")], ddl)
    assert sorted(map(tuple, upsert(stored, same, ["id"], ["title"]).collect())) == [(1, "b"), (2, "n")]
    ordered = spark.createDataFrame([(1, "z", 0), (1, "c", 1), (1, "d", 1)], "id long, title string, at int")
    for df in (ordered, ordered.repartition(3)):
        assert upsert(stored, df, ["id"], ["title"], order="at").collect()[0]["title"] == "d"
