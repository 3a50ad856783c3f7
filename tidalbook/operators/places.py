"""Points laid out along a space-filling curve, and radius search that reads few of their files.

The world is a grid of 2^``BITS`` x 2^``BITS`` cells whose numbers interleave the
bits of latitude and longitude, so near points mostly have near numbers.  A
table is cut into folders by the first bits (``tile``) and sorted by the number
inside them; a search turns its box into a few ranges of numbers, by which the
scan leaves out folders and, by the files' statistics, row groups.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo

#: Bits of an axis, and of an axis of a tile: 0.35 by 0.7 degrees.
BITS, TILE = 24, 9
#: Rows without a point.
NOWHERE = -1
#: Cells that a box is covered with, at most; the first ring of a search is its radius over so much, and each next one four times as wide.
CELLS, FIRST = 64, 16


def spread(x: Column) -> Column:
    """The bits of a number below 2^32 with a zero bit before each."""
    for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
    return x


def place(lat: Column, lng: Column) -> Column:
    """The number of a point's cell; null without a point."""
    steps = lambda x, low, wide: F.least(F.lit((1 << BITS) - 1), F.greatest(F.lit(0), F.floor((x - low) / wide * (1 << BITS)))).cast("long")
    here = spread(steps(lng, -180.0, 360.0)).bitwiseOR(F.shiftleft(spread(steps(lat, -90.0, 180.0)), 1))
    return F.when(lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng), here)


def woven(x: int, y: int) -> int:
    return sum(((x >> i & 1) << 2 * i) | ((y >> i & 1) << 2 * i + 1) for i in range(BITS))


def cover(lat: float, lng: float, radius: float) -> list[tuple[int, int]]:
    """Ranges of cell numbers, both ends included, that hold every point within ``radius``: ``CELLS`` at most."""
    south, north, west, east = geo.box(lat, lng, radius)
    if east - west >= 360:
        sides = [(-180.0, 180.0)]
    else:
        sides = [(max(west, -180.0), min(east, 180.0)), *[(west + 360, 180.0)] * (west < -180), *[(-180.0, east - 360)] * (east > 180)]
    top = (1 << BITS) - 1
    at = lambda v, low, wide: min(top, max(0, math.floor((v - low) / wide * (1 << BITS))))
    rows = at(south, -90.0, 180.0), at(north, -90.0, 180.0)
    columns = [(at(a, -180.0, 360.0), at(b, -180.0, 360.0)) for a, b in sides]
    shift = 0  # the finest cells that are few enough
    while ((rows[1] >> shift) - (rows[0] >> shift) + 1) * sum((b >> shift) - (a >> shift) + 1 for a, b in columns) > CELLS:
        shift += 1
    cells = sorted({woven(x, y) for y in range(rows[0] >> shift, (rows[1] >> shift) + 1) for a, b in columns for x in range(a >> shift, (b >> shift) + 1)})
    out: list[tuple[int, int]] = []
    for c in cells:
        low, high = c << 2 * shift, ((c + 1) << 2 * shift) - 1
        if out and out[-1][1] + 1 == low:
            out[-1] = out[-1][0], high
        else:
            out.append((low, high))
    return out


def lay_out(ledger: DataFrame, path: str) -> None:
    """Writes ``ledger`` in curve order; rows at one point are dealt by id, so that no task gets them all."""
    here = place(F.col("latitude"), F.col("longitude"))
    rows = ledger.withColumns({"place": here, "tile": F.coalesce(F.shiftright(here, 2 * (BITS - TILE)), F.lit(NOWHERE)).cast("long")})
    rows.repartitionByRange("tile", "place", "id").sortWithinPartitions("tile", "place", "id").write.partitionBy("tile").parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that ``lay_out`` wrote, ``schema`` without its own columns ``place`` and ``tile``."""
    own = [T.StructField("place", T.LongType()), T.StructField("tile", T.LongType())]
    return spark.read.schema(T.StructType([*schema.fields, *own])).parquet(path)


def within(table: DataFrame, lat: float, lng: float, radius: float) -> DataFrame:
    """Rows of the cells that touch the box of a radius; exact distances are the caller's."""
    ranges = cover(lat, lng, radius)
    tiles = sorted({t for a, b in ranges for t in range(a >> 2 * (BITS - TILE), (b >> 2 * (BITS - TILE)) + 1)})
    near = reduce(Column.__or__, [F.col("place").between(a, b) for a, b in ranges])
    there = F.col("tile").isin(tiles) if len(tiles) <= CELLS else F.col("tile").between(tiles[0], tiles[-1])
    return table.where(there & near)


def nearby(table: DataFrame, lat, lng, radius=None, most: int = geo.MOST) -> DataFrame:
    """What ``geo.nearby`` gives, from a table in curve order.

    Rings grow until one holds ``most`` rows or the radius is reached, so a
    search in a crowd reads the files around its centre only.
    """
    lat, lng, radius = geo.checked(lat, lng, radius)
    ring = radius / FIRST
    while ring < radius:
        found = geo.nearby(within(table, lat, lng, ring), lat, lng, ring, most)
        if found.count() == most:
            radius = ring
        ring *= 4
    return geo.nearby(within(table, lat, lng, radius), lat, lng, radius, most).drop("place", "tile")
