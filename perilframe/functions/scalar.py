"""Column expressions. All of them stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V

HASH_MODULUS = 4294967296  # 2^32
HASH_FACTOR = 2654435761
HASH_FOLD = 2147483647


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def polymorphic_id(text: Column | str) -> Column:
    """Id of a JSON fragment that is null, a bare id, or an object with an `id`."""
    text = col(text)
    return F.coalesce(F.get_json_object(text, "$.id"), text).try_cast("int")


def month_index(year: Column | str, month: Column | str) -> Column:
    """Months on one line, so the month before January is index - 1."""
    return (col(year) * 12 + col(month) - 1).cast("int")


def monday_zero(when: Column | str) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(col(when))


def casualty_flag(deaths: Column, injured: Column) -> Column:
    zero = F.lit(0)
    return ((F.coalesce(deaths, zero) > 0) | (F.coalesce(injured, zero) > 0)).cast("int")


def clipped(prediction: Column | str) -> Column:
    return F.greatest(col(prediction).cast("double"), F.lit(0.0))


def clip_round(prediction: Column | str, digits: int = 2) -> Column:
    """Never negative; half-even at the given digit."""
    return F.bround(clipped(prediction), digits)


def percent_label(probability: Column | str) -> Column:
    """Whole percent, halves up."""
    return F.floor(col(probability) * 100 + F.lit(0.5)).cast("int")


def _band(value: Column, bands) -> Column:
    expr = None
    for upper, name in bands:
        expr = F.when(value < upper, name) if expr is None else expr.when(value < upper, name)
    return F.when(value.isNotNull(), expr.otherwise(V.TOP_BAND))


def count_band(value: Column | str) -> Column:
    return _band(col(value), V.COUNT_BANDS)


def probability_band(value: Column | str) -> Column:
    return _band(col(value), V.PROBABILITY_BANDS)


def is_monsoon(month: Column | str) -> Column:
    return col(month).between(V.MONSOON_FIRST_MONTH, V.MONSOON_LAST_MONTH)


def tier(value: Column | str, edges) -> Column:
    """Index of the first edge that is not below the value, else the top tier."""
    value, expr = col(value), None
    for i, edge in enumerate(edges):
        expr = F.when(value <= edge, i) if expr is None else expr.when(value <= edge, i)
    return expr.otherwise(len(edges))


def spread_hash(key: Column | str, seed: int = V.SEED) -> Column:
    """Arithmetic hash in [0, 2^32) that any SQL engine reproduces and that cannot overflow."""
    folded = F.pmod(col(key).cast("bigint"), F.lit(HASH_FOLD).cast("bigint"))
    return F.pmod(folded * F.lit(HASH_FACTOR) + F.lit(seed).cast("bigint"), F.lit(HASH_MODULUS))
