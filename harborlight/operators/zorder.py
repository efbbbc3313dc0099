"""Tables of places clustered along a Z-order curve, and boxes as intervals of its key.

The key interleaves the bits of a row and a column of a grid of 2^16 by 2^16 cells. Rows are written in ranges of the key, sorted; a box
becomes a few intervals of keys, which the scan compares with the statistics of files and row groups, so that a box reads the row groups around
it. Where intervals hold cells beside the box, the box itself decides.

Defined cases: places without a position on Earth are not kept; a longitude of 180 is in the last column; a box over the
antimeridian is two; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..boxes import Box, parts
from ..functions.geo import in_bbox
from .predicates import valid_latitude, valid_longitude

BITS = 16
SIDE = 1 << BITS
#: Intervals that a box is cut into at most.
INTERVALS = 64
KEY = "_curve"


def _row(lat: float) -> int:
    return max(0, min(SIDE - 1, int((lat + 90) / 180 * SIDE)))


def _column(lon: float) -> int:
    return max(0, min(SIDE - 1, int((lon + 180) / 360 * SIDE)))


def _spread(x: Column) -> Column:
    """The 16 bits of a number, one place apart."""
    for by, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def curve_key(lat: Column, lon: Column) -> Column:
    """A place's key, a long of 32 bits."""
    cell = lambda x, low, width: F.least(F.lit(SIDE - 1), F.floor((x + low) / width * SIDE)).cast("long")
    return _spread(cell(lon, 90.0 * 2, 360.0)).bitwiseOR(F.shiftleft(_spread(cell(lat, 90.0, 180.0)), 1))


def intervals(box: Box, most: int = INTERVALS) -> list[tuple[int, int]]:
    """Inclusive intervals of keys that hold all of a box, by quarters of the grid: whole ones inside, ever smaller ones at the rim."""
    whole, rim = [], []
    for part in parts(box):
        sides = (_row(part.south), _row(part.north), _column(part.west), _column(part.east))
        heapq.heappush(rim, (-BITS, 0, 0, 0, sides))  # size, first key, row, column
    while rim and len(whole) + len(rim) <= most - 3:
        size, key, row, column, sides = heapq.heappop(rim)
        low, high, west, east = sides
        if size == 0:
            whole.append((key, key))
            continue
        half = -size - 1
        for quarter in range(4):
            r, c = row + ((quarter >> 1) << half), column + ((quarter & 1) << half)
            last = (1 << half) - 1
            if r > high or r + last < low or c > east or c + last < west:
                continue
            first = key + (quarter << 2 * half)
            if low <= r and r + last <= high and west <= c and c + last <= east:
                whole.append((first, first + (1 << 2 * half) - 1))
            else:
                heapq.heappush(rim, (-half, first, r, c, sides))
    out: list[tuple[int, int]] = []
    for first, last in sorted(whole + [(key, key + (1 << -2 * size) - 1) for size, key, *_ in rim]):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def write(places: DataFrame, path: str, row_group_bytes: int = 8 << 20) -> None:
    """Places (lat, lon, ...) in the order of the curve; every task writes a range of it."""
    placed = places.where(valid_latitude(F.col("lat")) & valid_longitude(F.col("lon"))).withColumn(KEY, curve_key(F.col("lat"), F.col("lon")))
    placed.repartitionByRange(KEY).sortWithinPartitions(KEY).write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


def read(spark: SparkSession, path: str, box: Box) -> DataFrame:
    """The places of a box."""
    near = F.lit(False)
    for first, last in intervals(box):
        near |= F.col(KEY).between(first, last)
    inside = in_bbox(F.col("lat"), F.col("lon"), box.south, box.north, box.west, box.east)
    return spark.read.parquet(path).where(near & inside).drop(KEY)
