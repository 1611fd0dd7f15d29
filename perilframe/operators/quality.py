"""Declarative table checks: one aggregate for all column rules, one grouping per unique key."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V


@dataclass(frozen=True)
class Rule:
    """A check on one column.

    `ok` is the pass predicate over non-null values (None for not_null and unique).
    The rule succeeds when at least `mostly` of the evaluated values pass.
    """

    name: str
    column: str
    kind: str
    ok: Column | None = None
    mostly: float = 1.0


def not_null(column: str) -> Rule:
    return Rule(f"not_null({column})", column, "not_null")


def unique(column: str) -> Rule:
    return Rule(f"unique({column})", column, "unique")


def in_set(column: str, values) -> Rule:
    return Rule(f"in_set({column})", column, "values", F.col(column).isin(list(values)))


def between(column: str, low=None, high=None, mostly: float = 1.0) -> Rule:
    """Inclusive bounds; either may be open."""
    tests = []
    if low is not None:
        tests.append(F.col(column) >= F.lit(low))
    if high is not None:
        tests.append(F.col(column) <= F.lit(high))
    return Rule(f"between({column})", column, "values", reduce(lambda a, b: a & b, tests), mostly)


def row_check(name: str, predicate: Column) -> Rule:
    """A predicate over the whole row; a null result fails."""
    return Rule(name, "*", "row", F.coalesce(predicate, F.lit(False)))


def incident_rules(as_of) -> list[Rule]:
    """The incident suite. `as_of` replaces the wall clock."""
    return [
        not_null("id"),
        unique("id"),
        in_set("hazard_id", range(V.HAZARD_ID_MIN, V.HAZARD_ID_MAX + 1)),
        not_null("incident_on"),
        between("loss_id", low=V.LOSS_ID_MIN),
        between("latitude", V.LATITUDE_MIN, V.LATITUDE_MAX, V.COORDINATE_MOSTLY),
        between("longitude", V.LONGITUDE_MIN, V.LONGITUDE_MAX, V.COORDINATE_MOSTLY),
        between("incident_on", high=as_of),
    ]


def incident_view(incidents: DataFrame) -> DataFrame:
    """The columns the incident suite looks at."""
    return incidents.select(
        "id", "hazard_id", "incident_on", "loss_id", F.col("lon").alias("longitude"), F.col("lat").alias("latitude")
    )


def leadlag_rules() -> list[Rule]:
    return [
        row_check("label in {0,1}", F.col("label").isin(0, 1)),
        row_check(
            "rain not null",
            F.col("rain_1d").isNotNull() & F.col("rain_3d").isNotNull() & F.col("rain_7d").isNotNull(),
        ),
        row_check("rain_7d >= rain_3d", F.col("rain_7d") >= F.col("rain_3d")),
        row_check("rain_3d >= rain_1d", F.col("rain_3d") >= F.col("rain_1d")),
    ]


def _failing(rule: Rule) -> Column:
    if rule.kind == "not_null":
        return F.col(rule.column).isNull()
    if rule.kind == "row":
        return ~rule.ok
    return F.col(rule.column).isNotNull() & ~rule.ok


def _evaluated(rule: Rule) -> Column:
    return F.lit(True) if rule.kind in ("not_null", "row") else F.col(rule.column).isNotNull()


def report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule: rule, column, evaluated, unexpected, fraction, success."""
    return judged(totals(df, rules))


def totals(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule: rule, column, mostly, evaluated, unexpected."""
    plain = [r for r in rules if r.kind != "unique"]
    parts = []
    if plain:
        counts = df.agg(
            *[F.count_if(_evaluated(r)).alias(f"e{i}") for i, r in enumerate(plain)],
            *[F.count_if(_failing(r)).alias(f"u{i}") for i, r in enumerate(plain)],
        )
        rows = [
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.column).alias("column"),
                F.lit(r.mostly).alias("mostly"),
                F.col(f"e{i}").alias("evaluated"),
                F.col(f"u{i}").alias("unexpected"),
            )
            for i, r in enumerate(plain)
        ]
        parts.append(counts.select(F.inline(F.array(*rows))))
    for r in (r for r in rules if r.kind == "unique"):
        copies = df.where(F.col(r.column).isNotNull()).groupBy(r.column).agg(F.count("*").alias("n"))
        parts.append(
            copies.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("evaluated"),
                F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("unexpected"),
            ).select(
                F.lit(r.name).alias("rule"),
                F.lit(r.column).alias("column"),
                F.lit(r.mostly).alias("mostly"),
                "evaluated",
                "unexpected",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def judged(counts: DataFrame) -> DataFrame:
    """The report of counted rules (see `totals`)."""
    fraction = F.when(F.col("evaluated") > 0, F.col("unexpected") / F.col("evaluated")).otherwise(F.lit(0.0))
    passed = F.when(
        F.col("evaluated") > 0,
        (F.col("evaluated") - F.col("unexpected")) / F.col("evaluated") >= F.col("mostly"),
    ).otherwise(F.lit(True))
    return counts.select(
        "rule", "column", "evaluated", "unexpected", fraction.alias("fraction"), passed.alias("success")
    )


def overall(result: DataFrame) -> DataFrame:
    return result.agg(
        F.count("*").alias("rules"),
        F.count_if("success").alias("passed"),
        F.bool_and("success").alias("success"),
    )


def violations(df: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """The rows that break a rule, one output row per (row, broken rule)."""
    plain = [r for r in rules if r.kind != "unique"]
    parts = []
    if plain:
        broken = F.filter(
            F.array(*[F.when(_failing(r), F.lit(r.name)) for r in plain]), lambda name: name.isNotNull()
        )
        parts.append(df.select(*keep, F.explode(broken).alias("rule")))
    for r in (r for r in rules if r.kind == "unique"):
        repeated = df.groupBy(r.column).agg(F.count("*").alias("n")).where("n > 1").select(r.column)
        parts.append(df.join(repeated, r.column, "left_semi").select(*keep, F.lit(r.name).alias("rule")))
    return reduce(DataFrame.unionByName, parts)


def require(result: DataFrame) -> None:
    """Raise if any rule failed (at most one row per rule comes back)."""
    failed = [row["rule"] for row in result.where(~F.col("success")).select("rule").collect()]
    if failed:
        raise ValueError(f"failed checks: {failed}")
