"""Every query with SQL returns the rows the SQL returns."""

import pytest

import __spark_entry__ as entry
import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    assert oracle.difference(df, con, entry.oracle_sql()[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    for shape in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "MapInPandas"):
        assert shape not in plan


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns[:4] == ["district", "hazard", "year", "month"]
