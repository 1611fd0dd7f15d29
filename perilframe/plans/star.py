"""The incident roles played by a star schema of orders, customers, nations and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import fixed_values as V
from ..operators.rain import Geometry
from ..session import configure

GEOMETRY = Geometry(lon0=0.0, lat0=0.0, size=1.0)


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; its schema is looked up once a process, as every look is a job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return configure(spark).read.schema(_SCHEMAS[path]).parquet(path)


def hazard_number(priority: str = "o_orderpriority"):
    return F.substring(priority, 1, 1).cast("int")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as incidents; the district is the customer's nation."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return orders.join(customers, "o_custkey").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Incident "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("Ne "), F.col("o_orderkey").cast("string")).alias("title_ne"),
        hazard_number().alias("hazard_id"),
        F.col("o_orderpriority").alias("hazard"),
        F.col("c_nationkey").alias("district_id"),
        F.col("o_orderdate").cast("timestamp").alias("incident_on"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("interval 6 hours")).alias("reported_on"),
        (F.col("o_orderstatus") == "F").alias("verified"),
        (F.col("o_orderstatus") != "P").alias("approved"),
        F.when(F.col("o_orderstatus") == "O", "field_desk").otherwise(V.FEED_NAME).alias("data_source"),
        (F.pmod("c_nationkey", F.lit(5)) + 0.25 + F.pmod("o_orderkey", F.lit(2)) * 0.5).alias("lon"),
        (F.floor(F.col("c_nationkey") / 5) + 0.5).alias("lat"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("custkey"),
    )


def raw_loss():
    """Loss in its four shapes: null, a bare id, an object, an object without id."""
    key = F.col("id").cast("string")
    price = F.col("price").cast("decimal(18,2)").cast("string")
    return (
        F.when(F.pmod("id", F.lit(4)) == 0, F.lit("null"))
        .when(F.pmod("id", F.lit(4)) == 1, key)
        .when(
            F.pmod("id", F.lit(4)) == 2,
            F.concat(
                F.lit('{"id":'), key, F.lit(',"estimatedLoss":'), price,
                F.when(F.col("status") == "P", F.lit(',"peopleDeathCount":1,"peopleInjuredCount":0')).otherwise(F.lit("")),
                F.lit("}"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit('{"estimatedLoss":'), price,
                F.when(F.col("status") == "P", F.lit(',"peopleInjuredCount":2')).otherwise(F.lit("")), F.lit("}"),
            )
        )
    )


def _text(c):
    return F.concat(F.lit('"'), c, F.lit('"'))


def raw_records(rows: DataFrame, title="title", modified="interval 1 day") -> DataFrame:
    """Incidents as landed JSON text: columns id, record."""
    when = lambda c: _text(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    flag = lambda c: F.col(c).cast("string")
    hazard = F.when(
        F.pmod("id", F.lit(2)) == 0, F.col("hazard_id").cast("string")
    ).otherwise(F.concat(F.lit('{"id":'), F.col("hazard_id").cast("string"), F.lit(',"title":"h"}')))
    point = F.when(F.pmod("id", F.lit(10)) == 9, F.lit("null")).otherwise(
        F.concat(
            F.lit('{"type":"Point","coordinates":['), F.col("lon").cast("string"), F.lit(","),
            F.col("lat").cast("string"), F.lit("]}"),
        )
    )
    title = F.col(title) if isinstance(title, str) else title
    return rows.select(
        "id",
        F.concat(
            F.lit('{"id":'), F.col("id").cast("string"),
            F.lit(',"title":'), _text(title),
            F.lit(',"titleNe":'), _text(F.col("title_ne")),
            F.lit(',"hazard":'), hazard,
            F.lit(',"incidentOn":'), when("incident_on"),
            F.lit(',"reportedOn":'), when("reported_on"),
            F.lit(',"verified":'), flag("verified"),
            F.lit(',"approved":'), flag("approved"),
            F.lit(',"source":"desk","dataSource":'), _text(F.col("data_source")),
            F.lit(',"point":'), point,
            F.lit(',"loss":'), raw_loss(),
            F.lit(',"createdOn":'), when("reported_on"),
            F.lit(',"modifiedOn":'), when(F.col("reported_on") + F.expr(modified)),
            F.lit("}"),
        ).alias("record"),
    )


def with_raw(rows: DataFrame) -> DataFrame:
    """Incidents with a raw_data column holding the loss in its four shapes."""
    return rows.withColumn("raw_data", F.concat(F.lit('{"loss":'), raw_loss(), F.lit("}")))


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"),
        F.concat(F.lit("Ne "), "n_name").alias("title_ne"),
        F.concat(F.lit("D"), F.col("n_nationkey").cast("string")).alias("code"),
        F.col("n_regionkey").alias("province_id"),
    )


def hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order priorities as the hazard dimension."""
    kinds = table(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    number = hazard_number()
    return kinds.select(
        number.alias("id"), F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("Ne "), "o_orderpriority").alias("title_ne"),
        F.when(number <= 3, "natural").otherwise("non natural").alias("type"),
        F.concat(F.lit("#00000"), number.cast("string")).alias("color"),
        F.concat(F.lit("icon-"), number.cast("string")).alias("icon_url"),
    )


def municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("title"),
        F.concat(F.lit("Ne "), "c_name").alias("title_ne"), F.col("c_mktsegment").alias("type"),
        F.concat(F.lit("M"), F.col("c_custkey").cast("string")).alias("code"),
        F.col("c_nationkey").alias("district_id"),
    )


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as daily rain per district: quantity shipped by the district's suppliers.

    A supplier ships little on a day, so a sum per (supplier, day) would be nearly as long as the lines; districts have few days.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return (
        lines.join(suppliers, "l_suppkey")
        .groupBy(F.col("s_nationkey").alias("district_id"), "date")
        .agg(F.sum("l_quantity").alias("precip_mm"))
    )


def rain_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_panel(spark, sf_dir).select(
        F.pmod("district_id", F.lit(5)).cast("int").alias("cell_x"),
        F.floor(F.col("district_id") / 5).cast("int").alias("cell_y"),
        "date", "precip_mm",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_points(incidents(spark, sf_dir))


def sample_points(rows: DataFrame) -> DataFrame:
    """Incident points to look rain up for."""
    return rows.select(
        F.col("id").alias("incident_id"), "district_id", F.to_date("incident_on").alias("incident_date"), "lon", "lat"
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic pseudo-score with many ties, for the metrics."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "P").cast("int").alias("label"),
        (F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)) / 1000).alias("score"),
        F.col("o_totalprice").alias("actual"),
        (F.col("o_totalprice") * 0.9 + F.pmod(F.col("o_orderkey"), F.lit(100))).alias("predicted"),
        hazard_number().alias("class_actual"),
        (F.pmod(F.col("o_orderkey"), F.lit(5)) + 1).cast("int").alias("class_predicted"),
    )
