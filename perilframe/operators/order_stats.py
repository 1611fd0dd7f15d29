"""Exact ranks, quantiles and running totals without a one-task window over facts.

Two tools:
* histogram refinement finds the value at a rank. Every pass groups by a cell
  number, so a pass returns at most CELLS rows per wanted rank no matter how
  many rows the table has, and hot values collapse in the map-side combine. The
  first pass has cells by magnitude, which need no range; once FEW rows are left, their values come back.
* running totals over distinct keys are taken per written key range; only the
  per-range sums meet in one place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stable

CELLS = 4096
FEW = 65_536  # values that are fetched as they are


@dataclass(frozen=True)
class Located:
    """The value at a rank, the rows strictly below it, and the rows equal to it."""

    value: object
    below: int
    equal: int


@dataclass
class _Span:
    low: object
    high: object
    below: int
    ranks: list[int]
    rows: int = 0


def _magnitude(value: Column) -> Column:
    """A cell number that rises with the value: a sixteenth of a power of two, by sign; some 70,000 cells at the very most."""
    v = value.cast("double")
    size = F.floor(F.log2(F.abs(v)) * 16).cast("int") + F.lit(1 << 15)
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))


def _cell(value: Column, span: _Span) -> Column:
    # Monotone in `value`; long subtraction stays exact before the division, in decimals where it could overflow.
    width = float(span.high - span.low) / CELLS
    if isinstance(span.low, int) and span.high - span.low >= 1 << 63:
        above = value.cast("decimal(20,0)") - F.lit(span.low).cast("decimal(20,0)")
    else:
        above = value - F.lit(span.low)
    raw = F.floor(above.cast("double") / F.lit(width))
    return F.least(raw.cast("int"), F.lit(CELLS - 1))


@dataclass(frozen=True)
class Ask:
    """Wanted 0-based ranks of a numeric key among the rows where a condition holds; NULL and NaN do not count.

    `wanted` is a list of ranks, or a function of the number of such rows.
    """

    key: Column
    wanted: object
    where: Column | None = None


def _cells_of(value: Column, spans: list[_Span]) -> tuple[Column, Column]:
    """The open span a value lies in, if any, and its cell there."""
    expr_span, expr_cell = None, None
    for i, span in enumerate(spans):
        inside = value.between(F.lit(span.low), F.lit(span.high))
        cell = F.lit(0) if span.low == span.high else _cell(value, span)
        expr_span = F.when(inside, i) if expr_span is None else expr_span.when(inside, i)
        expr_cell = F.when(inside, cell) if expr_cell is None else expr_cell.when(inside, cell)
    return expr_span, expr_cell


def _narrow(spans: list[_Span], cells: list, found: dict[int, Located]) -> list[_Span]:
    """Record the ranks that fell on a single value; return the cells that still hold several."""
    narrower = []
    for i, span in enumerate(spans):
        below, left = span.below, list(span.ranks)
        for row in sorted((r for r in cells if r["span"] == i), key=lambda r: (r["cell"], r["low"])):
            here = [r for r in left if r < below + row["n"]]
            if here:
                left = left[len(here):]
                if row["low"] == row["high"]:
                    for r in here:
                        found[r] = Located(row["low"], below, row["n"])
                elif (row["low"], row["high"]) == (span.low, span.high):
                    raise ValueError("values must be finite")
                else:
                    narrower.append(_Span(row["low"], row["high"], below, here, row["n"]))
            below += row["n"]
            if not left:
                break
    return narrower


def locate_many(df: DataFrame, asks: list[Ask]) -> list[list[Located]]:
    """Per ask, the values at its wanted ranks, in the order asked for. All asks share every pass over df.

    The keys must have one type. One pass counts by magnitude; each further one narrows all open ranges to a cell.
    """
    if not asks:
        return []
    values = df.select(*[(a.key if a.where is None else F.when(a.where, a.key)).alias(f"v{i}") for i, a in enumerate(asks)])
    kinds = {f.dataType.typeName() for f in values.schema}
    if len(kinds) > 1:
        raise TypeError(f"keys of different types: {sorted(kinds)}")
    if kinds & {"double", "float"}:
        values = values.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in values.columns])
    cells = _counted(values, [F.struct(F.lit(i).alias("ask"), F.lit(0).alias("span"), _magnitude(F.col(f"v{i}")).alias("cell"), F.col(f"v{i}").alias("v")) for i in range(len(asks))])
    wanted, found, spans = [], [], {}
    for i, ask in enumerate(asks):
        here = [r for r in cells if r["ask"] == i]
        total = sum(r["n"] for r in here)
        if any(isinstance(r["high"], float) and (math.isinf(r["low"]) or math.isinf(r["high"])) for r in here):
            raise ValueError("values must be finite")
        ranks = list(ask.wanted(total)) if callable(ask.wanted) else list(ask.wanted)
        if any(r < 0 or r >= total for r in ranks):
            raise ValueError(f"ranks {ranks} do not fit {total} rows")
        wanted.append(ranks)
        found.append({})
        if ranks:
            spans[i] = _narrow([_Span(None, None, 0, sorted(set(ranks)), total)], here, found[i])
    spans = {i: some for i, some in spans.items() if some}
    while spans:
        reach = F.lit(False)  # plain ranges, which can reach the scan
        few = sum(s.rows for some in spans.values() for s in some) <= FEW
        places = []
        for i, some in spans.items():
            v = F.col(f"v{i}")
            reach = reach | v.between(F.lit(some[0].low), F.lit(some[-1].high))
            span, cell = _cells_of(v, some)
            places.append(F.struct(F.lit(i).alias("ask"), span.alias("span"), (F.lit(0) if few else cell).alias("cell"), v.alias("v")))
        cells = _counted(values.where(reach), places, ["v"] if few else [])
        spans = {i: _narrow(some, [r for r in cells if r["ask"] == i], found[i]) for i, some in spans.items()}
        spans = {i: some for i, some in spans.items() if some}
    return [[f[r] for r in ranks] for f, ranks in zip(found, wanted)]


def _counted(values: DataFrame, places: list[Column], by: list[str] = []) -> list:  # noqa: B006
    """Rows, lowest and highest value per (ask, span, cell), and per value if `by` says so."""
    inside = values.select(F.inline(F.array(*places))).where("span is not null and v is not null")
    return inside.groupBy("ask", "span", "cell", *by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()


def locate_ranks(df: DataFrame, key: Column, wanted) -> list[Located]:
    """Values at the wanted 0-based ranks of one numeric key, in the order asked for."""
    return locate_many(df, [Ask(key, wanted)])[0]


def quantiles_many(df: DataFrame, keys: list[Column | str], probabilities) -> list[list[float]]:
    """Exact quantiles with linear interpolation between the two nearest ranks, per key, from shared passes."""
    points: list[list[float]] = [[] for _ in keys]

    def ranks(i: int):
        def of(total: int) -> list[int]:
            points[i].extend(p * (total - 1) for p in probabilities)
            return [r for x in points[i] for r in (math.floor(x), math.ceil(x))]

        return of

    values = [(F.col(k) if isinstance(k, str) else k).cast("double") for k in keys]
    at = locate_many(df, [Ask(v, ranks(i)) for i, v in enumerate(values)])
    return [
        [lo.value + (hi.value - lo.value) * (x - math.floor(x)) for x, lo, hi in zip(points[i], at[i][0::2], at[i][1::2])]
        for i in range(len(keys))
    ]


def quantiles(df: DataFrame, key: Column | str, probabilities) -> list[float]:
    return quantiles_many(df, [key], probabilities)[0]


def first_rows_of_each(df: DataFrame, strata: list[Column], keys: list[Column], takes: list[int]) -> list[Column]:
    """Per stratum, the predicate that holds for its first `take` rows in key order (see `first_rows`), from shared passes."""
    chosen, tied, left = [F.lit(False) for _ in strata], list(strata), list(takes)
    open_ = [i for i, take in enumerate(takes) if take > 0]
    for key in keys:
        located = locate_many(df, [Ask(key, [left[i] - 1], tied[i]) for i in open_])
        still = []
        for i, (at,) in zip(open_, located):
            if at.below + at.equal == left[i]:
                chosen[i] = chosen[i] | (tied[i] & (key <= F.lit(at.value)))
                continue
            chosen[i] = chosen[i] | (tied[i] & (key < F.lit(at.value)))
            tied[i] = tied[i] & (key == F.lit(at.value))
            left[i] -= at.below
            still.append(i)
        open_ = still
        if not open_:
            return chosen
    raise ValueError("the last key is not unique among tied rows")


def first_rows(df: DataFrame, keys: list[Column], take) -> Column:
    """Predicate that holds for exactly the first `take` rows in key order.

    `take` is a number, or a function of the row count that spares a separate count. The keys are
    non-null integers and the last one is unique among ties. The result is a plain
    comparison with literals, so marking the rows costs no shuffle.
    """
    if not callable(take) and take <= 0:
        return F.lit(False)
    asked: list[int] = []

    def last_rank(rows: int) -> list[int]:
        asked.append(take(rows) if callable(take) else take)
        return [asked[0] - 1] if asked[0] > 0 else []

    chosen, tied, wanted = F.lit(False), F.lit(True), last_rank
    for key in keys:
        located = locate_ranks(df.where(tied), key, wanted)
        if not located:
            return F.lit(False)
        at, left = located[0], asked[0]
        if at.below + at.equal == left:
            return chosen | (tied & (key <= F.lit(at.value)))
        chosen = chosen | (tied & (key < F.lit(at.value)))
        tied = tied & (key == F.lit(at.value))
        asked[0] = left - at.below
        wanted = [asked[0] - 1]
    raise ValueError("the last key is not unique among tied rows")


def running_totals(
    keyed: DataFrame, key: str, values: list[str], by: tuple[str, ...] = (), ranges: int | None = None
) -> DataFrame:
    """For one row per (by, key), add per v: `<v>_before`, the sum over smaller keys, and `<v>_total`.

    The rows are written once in key order; Spark balances the key ranges of the files, and small
    inputs end up in one file. Sums inside a file need only that file, and only the per-file sums
    (as many rows as files, plus one per group) meet in one place. `ranges` fixes the number of ranges.
    """
    order = [*by, key]
    if ranges is None:
        ordered = keyed.orderBy(*order)
    else:
        ordered = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    table = stable(ordered).select("*", F.col("_metadata.file_name").alias("_file"))

    sums = table.groupBy(*by, "_file").agg(F.min(key).alias("_first"), *[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    offsets = sums.select(
        *by,
        "_file",
        *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values],
        *[F.sum(f"_{v}").over(group).alias(f"{v}_total") for v in values],
    )
    local = Window.partitionBy(*by, "_file").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    within = table.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"{v}_before") for v in values])
    return within.join(offsets, [*by, "_file"]).select(
        *keyed.columns,
        *[(F.col(f"{v}_before") + F.col(f"_{v}")).alias(f"{v}_before") for v in values],
        *[f"{v}_total" for v in values],
    )
