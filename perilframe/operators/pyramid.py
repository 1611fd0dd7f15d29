"""Marker clusters for every zoom of a map, each coarser level summed up from the finer one.

A cluster's key is the Morton code of its tile: the bits of column and row in turn. The tile of the next coarser zoom is the
key without its last two bits, and tiles that are near on the map are near in key order, so levels stored by key are
read in runs. Positions are added up as whole millionths of a degree: sums are exact in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stable

FINEST = 12  # levels; a tile of zoom z spans 360 / 2^z by 180 / 2^z degrees
UNIT = 1_000_000  # parts of a degree

# Masks that spread 32 bits to every other place of 64.
_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _spread(bits: Column) -> Column:
    for shift, mask in _SPREAD:
        bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
    return bits


def _tile(degrees: Column, low: float, span: float, zoom: int) -> Column:
    """Column or row of a tile; the far edge belongs to the last one."""
    side = 1 << zoom
    at = F.floor((degrees - F.lit(low)) / F.lit(span) * F.lit(float(side)))
    return F.least(F.greatest(at, F.lit(0)), F.lit(side - 1)).cast("bigint")


def tile_key(lon: Column, lat: Column, zoom: int) -> Column:
    column, row = _tile(lon, -180.0, 360.0, zoom), _tile(lat, -90.0, 180.0, zoom)
    return _spread(column).bitwiseOR(F.shiftleft(_spread(row), 1))


def finest(points: DataFrame, zoom: int = FINEST, extra: list[Column] | None = None) -> DataFrame:
    """Clusters of the finest zoom: zoom, key, points, sums of the position, and the smallest id. Points have id, longitude, latitude."""
    lon, lat = F.col("longitude"), F.col("latitude")
    whole = lambda c: F.round(c * UNIT).cast("bigint")
    return points.groupBy(F.lit(zoom).alias("zoom"), tile_key(lon, lat, zoom).alias("key")).agg(
        F.count("*").alias("points"), F.sum(whole(lon)).alias("lon_sum"), F.sum(whole(lat)).alias("lat_sum"),
        F.min("id").alias("first_id"), *(extra or []),
    )


def coarser(level: DataFrame) -> DataFrame:
    """The next zoom out: at most four clusters become one."""
    return level.groupBy((F.col("zoom") - 1).alias("zoom"), F.shiftright("key", 2).alias("key")).agg(
        *[F.sum(c).alias(c) for c in ("points", "lon_sum", "lat_sum")], F.min("first_id").alias("first_id")
    )


def pyramid(points: DataFrame, zoom: int = FINEST) -> list[DataFrame]:
    """Levels from the finest zoom to 0, written in key order; the points are read once."""
    levels = [stable(finest(points, zoom).orderBy("key"))]
    for _ in range(zoom):
        levels.append(stable(coarser(levels[-1]).orderBy("key")))
    return levels


def clusters(levels: list[DataFrame]) -> DataFrame:
    """zoom, key, points, center_lon, center_lat, first_id of all levels."""
    return reduce(DataFrame.unionByName, levels).select(
        "zoom", "key", "points", (F.col("lon_sum") / F.col("points") / UNIT).alias("center_lon"),
        (F.col("lat_sum") / F.col("points") / UNIT).alias("center_lat"), "first_id",
    )


def in_view(level: DataFrame, zoom: int, west: float, south: float, east: float, north: float) -> DataFrame:
    """Clusters of a zoom whose tile meets a box. The box's corners bound the keys, which prunes a level stored by key."""
    low = tile_key(F.lit(west), F.lit(south), zoom)
    high = tile_key(F.lit(east), F.lit(north), zoom)
    columns = [_squeezed(F.col("key")), _squeezed(F.shiftright("key", 1))]
    inside = [
        c.between(_tile(F.lit(a), edge, span, zoom), _tile(F.lit(b), edge, span, zoom))
        for c, a, b, edge, span in zip(columns, (west, south), (east, north), (-180.0, -90.0), (360.0, 180.0))
    ]
    return level.where(F.col("key").between(low, high) & inside[0] & inside[1])


def _squeezed(bits: Column) -> Column:
    """Every other bit, the opposite of `_spread`."""
    bits = bits.bitwiseAND(F.lit(_SPREAD[-1][1]))
    masks = [m for _, m in reversed(_SPREAD)][1:] + [0x00000000FFFFFFFF]
    for (shift, _), mask in zip(reversed(_SPREAD), masks):
        bits = bits.bitwiseOR(F.shiftright(bits, shift)).bitwiseAND(F.lit(mask))
    return bits
