"""Tables that model queries read several times are built and written once."""

from pyspark.sql import functions as F

from perilframe.plans import datasets, models, star
from perilframe.registry import modelling, tables


def _folder(spark, at):
    """400 orders of 20 customers in 5 nations over 40 days, some keys twice or null, with their lines."""
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), (c % 40).cast("int"))
    n = F.col("id")
    spark.range(400).select(
        F.when(n % 50 != 7, n - (n % 60 == 1).cast("int")).alias("o_orderkey"), F.when(n % 70 != 5, n % 20).alias("o_custkey"),
        F.element_at(F.array(*map(F.lit, "FOP")), (n % 3 + 1).cast("int")).alias("o_orderstatus"), (n * 1.25 + 10).alias("o_totalprice"),
        F.when(n % 90 != 8, day(n * 7)).alias("o_orderdate"), F.concat((n % 5 + 1).cast("string"), F.lit("-KIND")).alias("o_orderpriority"),
    ).write.parquet(f"{at}/orders.parquet")
    spark.range(20).selectExpr("id as c_custkey", "cast(id % 5 as int) as c_nationkey").write.parquet(f"{at}/customer.parquet")
    spark.range(10).selectExpr("id as s_suppkey", "cast(id % 5 as int) as s_nationkey").write.parquet(f"{at}/supplier.parquet")
    spark.range(5).selectExpr("cast(id as int) as n_nationkey", "concat('N', id) as n_name", "0 as n_regionkey").write.parquet(f"{at}/nation.parquet")
    spark.range(3000).select((n % 10).alias("l_suppkey"), day(F.floor(n / 10)).alias("l_shipdate"), (n % 9).cast("double").alias("l_quantity")).write.parquet(
        f"{at}/lineitem.parquet"
    )
    return str(at)


def _counted(monkeypatch, name):
    made, build = [], getattr(star, name)
    monkeypatch.setattr(star, name, lambda *a: (made.append(a), build(*a))[1])
    return made


def test_reports_and_their_rain_share_one_incident_table(spark, tmp_path, monkeypatch):
    at = _folder(spark, tmp_path / "sf")
    plain = [
        make(star.with_raw(star.incidents(spark, at)), tables.rain_at_incidents(spark, at)) for make in (datasets.severity_dataset, datasets.loss_dataset)
    ]
    made = _counted(monkeypatch, "incidents")
    for want, make in zip(plain, (tables.severity, tables.losses)):
        got = make(spark, at)
        assert got.columns == want.columns and got.count() > 100 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert len(made) == 2


def test_score_hazard_builds_incidents_and_grid_once(spark, tmp_path, monkeypatch):
    at = _folder(spark, tmp_path / "sf")
    monkeypatch.setattr(modelling.models.V, "GBT_LEADLAG", {"maxIter": 2, "maxDepth": 2})
    made, grids = _counted(monkeypatch, "incidents"), _counted(monkeypatch, "rain_grid")
    scored = modelling.score_hazard(spark, at)
    assert scored.count() > 100 and scored.where("risk_probability < 0 or risk_probability > 1").count() == 0
    assert len(made) == len(grids) == 1


def test_a_lead_lag_set_is_written_once_for_its_fit(spark, tmp_path, monkeypatch):
    at = _folder(spark, tmp_path / "sf")
    widths, write = [], models.stable
    both = lambda df, order=None: (widths.append(df.columns), write(df, order))[1]
    for module in (models, modelling, tables):
        monkeypatch.setattr(module, "stable", both)
    models.fit_leadlag(modelling._training(spark, at), {"maxIter": 2, "maxDepth": 2})
    whole = [c for c in widths if {"row_id", "label"} <= set(c)]
    assert [("is_test" in c) for c in whole] == [False, True]  # the set, and the small half's layout
