"""Landed JSON: page files or one report per line, to typed incident rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as V, schema
from ..functions.scalar import polymorphic_id
from ..session import stable


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page files named by number: columns page, body."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"(\d+)[^/\d]*$", 1).cast("bigint").alias("page"),
        F.col("value").alias("body"),
    )


def _pages_of_feed(pages: DataFrame) -> DataFrame:
    """Pages up to the end of the feed, parsed as `p`, with `broken` for those that did not parse.

    The feed ends before the first page without results, whatever its `next` says, and after the first page
    without `next`. A page that does not parse says nothing about the end. Every body is parsed once: the parse is
    written, and the end is looked up there.
    """
    parse = F.from_json("body", schema.PAGE, {"columnNameOfCorruptRecord": "_broken"})
    # The one-element explode keeps the optimizer from copying the parse into what is made of it.
    parsed = pages.select("page", "body", F.explode(F.array(parse)).alias("p"))
    broken = F.col("p").isNull() | F.col("p._broken").isNotNull()
    parsed = stable(parsed.select("page", F.when(broken, F.col("body")).alias("body"), F.struct("p.results", "p.next").alias("p"), broken.alias("broken")))
    empty = F.coalesce(F.size("p.results"), F.lit(0)) <= 0
    ends_at = F.when(F.col("broken"), None).when(empty, F.col("page") - 1).when(F.col("p.next").isNull(), F.col("page"))
    last = parsed.agg(F.min(ends_at).alias("last")).scalar()
    return parsed.withColumn("last", last).where("last is null or page <= last")


def page_records(pages: DataFrame) -> DataFrame:
    """Records of the feed: columns page, at (place in the page) and record (JSON text). (page, at) is their arrival.

    Pages past the end are ignored; pages that do not parse are in `page_rejects` and cost no other page.
    """
    good = _pages_of_feed(pages).where("not broken")
    return good.select("page", F.posexplode("p.results").alias("at", "record"))


def page_rejects(pages: DataFrame) -> DataFrame:
    """Pages of the feed that did not parse: page, body, reason."""
    return _pages_of_feed(pages).where("broken").select("page", "body", F.lit("page is not JSON").alias("reason"))


def _time(c: Column) -> Column:
    return c.try_cast("timestamp")


def _coordinate(point: Column, i: int) -> Column:
    return F.get_json_object(point, f"$.coordinates[{i}]").try_cast("double")


def _bad_id(raw: Column) -> Column:
    """Present, not an object without an id, and not a whole number that fits."""
    without_id = raw.startswith("{") & F.get_json_object(raw, "$.id").isNull()
    return raw.isNotNull() & ~without_id & polymorphic_id(raw).isNull()


def _bad_point(raw: Column) -> Column:
    """Present, and neither an object without coordinates nor one with two numbers or more."""
    coordinates = F.get_json_object(raw, "$.coordinates")
    absent = raw.startswith("{") & (coordinates.isNull() | (coordinates == "[]"))
    return raw.isNotNull() & ~absent & (_coordinate(raw, 0).isNull() | _coordinate(raw, 1).isNull())


def parse(records: DataFrame, text: str = "record") -> DataFrame:
    """Add the parsed report as `_r`, so that checks and columns share one pass over the JSON.

    The one-element explode keeps later filters above the parse; as a plain column the
    optimizer would copy the parse into every predicate on it.
    """
    if "_r" in records.columns:
        return records
    return records.select("*", F.explode(F.array(F.from_json(text, schema.REPORT))).alias("_r"))


def flatten(records: DataFrame, text: str = "record") -> DataFrame:
    """The 15 stored columns, and the record text as raw_data.

    Values that do not convert become NULL here; `with_reason` tells why.
    """
    r = lambda name: F.col(f"_r.{name}")
    return parse(records, text).select(
        r("id").try_cast("bigint").alias("id"),
        r("title").alias("title"),
        r("titleNe").alias("title_ne"),
        polymorphic_id(r("hazard")).alias("hazard_id"),
        _time(r("incidentOn")).alias("incident_on"),
        _time(r("reportedOn")).alias("reported_on"),
        r("verified").try_cast("boolean").alias("verified"),
        r("approved").try_cast("boolean").alias("approved"),
        r("source").alias("source"),
        r("dataSource").alias("data_source"),
        _coordinate(r("point"), 0).alias("lon"),
        _coordinate(r("point"), 1).alias("lat"),
        polymorphic_id(r("loss")).alias("loss_id"),
        _time(r("createdOn")).alias("created_on"),
        _time(r("modifiedOn")).alias("modified_on"),
        F.col(text).alias("raw_data"),
    )


REPORT_VARIANT = "report"


def with_variant(records: DataFrame, text: str = "record") -> DataFrame:
    """Add the report as a VARIANT column, parsed once at intake; text that is no JSON gives null.

    Later reads take their paths from the stored binary form (`from_variant`) and never parse the text again.
    """
    return records.withColumn(REPORT_VARIANT, F.try_parse_json(text))


def from_variant(path: str, kind: str, column: str = REPORT_VARIANT) -> Column:
    """The value at a path, null where it is absent or does not convert."""
    return F.try_variant_get(column, path, kind)


def variant_id(field: str, column: str = REPORT_VARIANT) -> Column:
    """Id of a field that is absent, a bare id, or an object with an `id`."""
    return F.coalesce(from_variant(f"$.{field}.id", "int", column), from_variant(f"$.{field}", "int", column))


def with_reason(records: DataFrame, text: str = "record") -> DataFrame:
    """Parsed records with `reason`: why a record cannot be stored; null for a good one."""
    r = F.col("_r")
    bad_time = [
        F.when(r[n].isNotNull() & _time(r[n]).isNull(), F.lit(f"bad {n}"))
        for n in ("incidentOn", "reportedOn", "createdOn", "modifiedOn")
    ]
    bad_flag = [
        F.when(r[n].isNotNull() & r[n].try_cast("boolean").isNull(), F.lit(f"bad {n}")) for n in ("verified", "approved")
    ]
    reason = F.coalesce(
        F.when(r["id"].isNull(), F.lit("no id")),
        F.when(r["id"].try_cast("bigint").isNull(), F.lit("bad id")),
        *bad_time,
        *bad_flag,
        F.when(_bad_id(r["hazard"]), F.lit("bad hazard")),
        F.when(_bad_id(r["loss"]), F.lit("bad loss")),
        F.when(_bad_point(r["point"]), F.lit("bad point")),
    )
    return parse(records, text).withColumn("reason", reason)


def split_rejects(records: DataFrame, text: str = "record") -> tuple[DataFrame, DataFrame]:
    """(good records, rejected records with a reason). One bad record never costs its neighbours."""
    judged = with_reason(records, text)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").drop("_r")


def trailing_window(incidents: DataFrame, as_of, days_back: int = V.INTAKE_DAYS, feed: str = V.FEED_NAME) -> DataFrame:
    """Reports of the feed strictly inside (as_of - days, as_of). Literal bounds reach the scan."""
    end = F.lit(as_of).cast("timestamp")
    return incidents.where(
        (F.col("data_source") == feed)
        & (F.col("incident_on") > end - F.make_dt_interval(days=F.lit(days_back)))
        & (F.col("incident_on") < end)
    )


HAZARD_RECORD = "id int, title string, titleNe string, type string, color string, icon string"
DISTRICT_RECORD = "id int, title string, title_ne string, code string, province int"
MUNICIPALITY_RECORD = "id int, title string, title_ne string, type string, code string, district int"


def _arrival(records: DataFrame) -> list[Column]:
    """The place at which a record of a page arrived, as `arrival`; nothing for records from elsewhere."""
    return [F.struct("page", "at").alias("arrival")] if {"page", "at"} <= set(records.columns) else []


def flatten_hazards(records: DataFrame, text: str = "record") -> DataFrame:
    return records.select("*", F.from_json(text, HAZARD_RECORD).alias("r")).select(
        "r.id", "r.title", F.col("r.titleNe").alias("title_ne"), "r.type", "r.color", F.col("r.icon").alias("icon_url"),
        *_arrival(records),
    )


def flatten_districts(records: DataFrame, text: str = "record") -> DataFrame:
    return records.select("*", F.from_json(text, DISTRICT_RECORD).alias("r")).select(
        "r.id", "r.title", "r.title_ne", "r.code", F.col("r.province").alias("province_id"), *_arrival(records)
    )


def flatten_municipalities(records: DataFrame, text: str = "record") -> DataFrame:
    return records.select("*", F.from_json(text, MUNICIPALITY_RECORD).alias("r")).select(
        "r.id", "r.title", "r.title_ne", "r.type", "r.code", F.col("r.district").alias("district_id"), *_arrival(records)
    )
