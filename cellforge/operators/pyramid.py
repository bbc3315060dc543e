"""Overviews of a map at all levels, and cells along a curve that keeps neighbours together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .remap import CELL


def spread(x: Column) -> Column:
    """The lower 31 bits of ``x`` with a free bit in front of each."""
    x = x.cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(r: str | Column = "r", c: str | Column = "c") -> Column:
    """The place of a cell on the Z-shaped curve: bits of row and column by turns; neither may be below 0. A block of 2**k by 2**k cells is one stretch of it, with a key that is shorter by 2 * k bits."""
    column = lambda v: F.col(v) if isinstance(v, str) else v
    return F.shiftleft(spread(column(r)), 1).bitwiseOR(spread(column(c)))


def histograms(cells: DataFrame, value: str, levels: int) -> DataFrame:
    """(level, r, c, value, n): how often each value occurs below each cell of levels 1 to ``levels``, blocks of 2, 4, 8... cells a side. A level is made from the sums of the one below, so each has about a quarter of its rows; nulls do not count."""
    made, below = [], cells.where(F.col(value).isNotNull()).select(*CELL, value, F.lit(1).cast("long").alias("n"))
    for level in range(1, levels + 1):
        up = lambda v: F.floor(F.col(v) / 2).cast("int").alias(v)
        below = below.groupBy(up("r"), up("c"), value).agg(F.sum("n").alias("n"))
        made.append(below.select(F.lit(level).alias("level"), *CELL, value, "n"))
    return reduce(DataFrame.unionByName, made)


def pyramid(cells: DataFrame, value: str, levels: int) -> DataFrame:
    """(level, key, r, c, value) of all levels in one plan: the most frequent value below each cell, the smallest if equal; ``key`` is its ``morton`` place, so the four cells below it are 4 * key to 4 * key + 3. Rows and columns may not be below 0."""
    top = histograms(cells, value, levels).groupBy("level", *CELL).agg(F.max_by(value, F.struct("n", -F.col(value))).alias(value))
    return top.select("level", morton().alias("key"), *CELL, value)
