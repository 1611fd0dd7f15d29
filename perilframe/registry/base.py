"""Collects named queries with the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as V

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def day_text(c: Column | str) -> Column:
    """Dates and times leave as ISO text, the same in every engine."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def time_text(c: Column | str) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


# Shared SQL building blocks.
INC = """inc AS (
  SELECT o_orderkey AS id, 'Incident ' || o_orderkey AS title, 'Ne ' || o_orderkey AS title_ne,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS hazard_id, o_orderpriority AS hazard,
         c_nationkey AS district_id, n_name AS district, o_orderdate AS incident_on,
         o_orderdate + INTERVAL 6 HOUR AS reported_on,
         o_orderstatus = 'F' AS verified, o_orderstatus <> 'P' AS approved,
         CASE WHEN o_orderstatus = 'O' THEN 'field_desk' ELSE '{FEED}' END AS data_source,
         (c_nationkey % 5) + 0.25e0 + (o_orderkey % 2) * 0.5e0 AS lon,
         floor(c_nationkey / 5.0e0) + 0.5e0 AS lat,
         o_orderstatus AS status, o_totalprice AS price, o_custkey AS custkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""".replace("{FEED}", V.FEED_NAME)

COUNTS = """counts AS (
  SELECT district, hazard, CAST(year(incident_on) AS INTEGER) AS year, CAST(month(incident_on) AS INTEGER) AS month,
         count(*) AS incident_count
  FROM inc GROUP BY 1, 2, 3, 4)"""

GRID = """grid AS (
  SELECT d.district, h.hazard, p.year, p.month, CAST(coalesce(c.incident_count, 0) AS BIGINT) AS incident_count
  FROM (SELECT DISTINCT district FROM counts) d
  CROSS JOIN (SELECT DISTINCT hazard FROM counts) h
  CROSS JOIN (SELECT DISTINCT year, month FROM counts) p
  LEFT JOIN counts c ON c.district = d.district AND c.hazard = h.hazard AND c.year = p.year AND c.month = p.month)"""

PANEL = """panel AS (
  SELECT * FROM (
    SELECT *, lag(incident_count) OVER (PARTITION BY district, hazard ORDER BY year, month) AS prev_month_count,
           avg(incident_count) OVER (PARTITION BY district, hazard, month) AS historical_month_avg
    FROM grid) WHERE prev_month_count IS NOT NULL)"""

RAIN = """rain AS (
  SELECT s_nationkey AS district_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS precip_mm
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""

# Rain windows at every (district, day) an incident asks for, ungated.
KEYRAIN = """keyrain AS (
  SELECT k.district_id, k.d,
         sum(CASE WHEN r.date >= k.d - 1 THEN r.precip_mm END) AS rain_1d,
         sum(CASE WHEN r.date >= k.d - 3 THEN r.precip_mm END) AS rain_3d,
         sum(r.precip_mm) AS rain_7d, max(r.precip_mm) AS rain_peak_7d
  FROM (SELECT DISTINCT district_id, CAST(incident_on AS DATE) AS d FROM inc) k
  LEFT JOIN rain r ON r.district_id = k.district_id AND r.date >= k.d - 7 AND r.date < k.d
  GROUP BY 1, 2)"""

# Rain at incidents: the day before must have an image somewhere on the grid.
INCRAIN = """incrain AS (
  SELECT id AS incident_id, i.district_id, CAST(incident_on AS DATE) AS incident_date, rain_1d, rain_3d, rain_7d, rain_peak_7d
  FROM inc i JOIN keyrain k ON k.district_id = i.district_id AND k.d = CAST(i.incident_on AS DATE)
  WHERE CAST(incident_on AS DATE) - 1 IN (SELECT date FROM rain))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
