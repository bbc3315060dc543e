"""Polygons on a grid: rasterising by an even-odd test and overlay by cells.

Polygons are rows (id, x array<double>, y array<double>), closed or not. A range join of bounding
boxes becomes an equi-join on square blocks of cells that each box covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


def inside(px: Column, py: Column, x: Column, y: Column) -> Column:
    """Whether (px, py) is inside the ring: an odd number of edges cross the ray to its right."""
    n = F.size(x)
    crossings = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s
        + F.when(
            ((F.element_at(y, i) > py) != (F.element_at(y, F.when(i == 1, n).otherwise(i - 1)) > py))
            & (
                px
                < (F.element_at(x, F.when(i == 1, n).otherwise(i - 1)) - F.element_at(x, i))
                * (py - F.element_at(y, i))
                / (F.element_at(y, F.when(i == 1, n).otherwise(i - 1)) - F.element_at(y, i))
                + F.element_at(x, i)
            ),
            1,
        ).otherwise(0),
    )
    return crossings % 2 == 1


def crossed(px: Column, py: Column, x: Column, y: Column) -> Column:
    """Whether an edge of the ring passes through the inside of the unit cell around (px, py)."""
    n = F.size(x)

    def through(i: Column) -> Column:
        before = F.when(i == 1, n).otherwise(i - 1)
        x0, y0, x1, y1 = F.element_at(x, before), F.element_at(y, before), F.element_at(x, i), F.element_at(y, i)
        over = lambda p, a, b: (F.least(a, b) < p + 0.5) & (F.greatest(a, b) > p - 0.5)
        dx, dy = x1 - x0, y1 - y0
        return over(px, x0, x1) & over(py, y0, y1) & (F.abs(dx * (py - y0) - dy * (px - x0)) < 0.5 * (F.abs(dx) + F.abs(dy)))

    return F.exists(F.sequence(F.lit(1), n), through)


def rasterize(cells: DataFrame, polygons: DataFrame, id_column: str = "id", block: int = BLOCK, all_touched: bool = False) -> DataFrame:
    """(r, c, id): polygons in which a cell's centre (c + 0.5, r + 0.5) lies; with ``all_touched`` also those with an edge through the cell (along its border is not through it)."""
    b = lambda v: F.floor(v / block).cast("int")
    boxed = polygons.withColumn("br", F.explode(F.sequence(b(F.array_min("y")), b(F.array_max("y"))))).withColumn("bc", F.explode(F.sequence(b(F.array_min("x")), b(F.array_max("x")))))
    x = cells.select("r", "c").withColumns({"br": b(F.col("r")), "bc": b(F.col("c"))}).join(boxed, ["br", "bc"])
    px, py = F.col("c") + 0.5, F.col("r") + 0.5
    near = (px + 0.5 > F.array_min("x")) & (px - 0.5 < F.array_max("x")) & (py + 0.5 > F.array_min("y")) & (py - 0.5 < F.array_max("y"))
    hit = inside(px, py, F.col("x"), F.col("y"))
    if all_touched:
        hit = hit | crossed(px, py, F.col("x"), F.col("y"))
    return x.where(near & hit).select("r", "c", id_column)


def cell_overlay(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """(a_id, b_id, n): cells that two rasterised layers share."""
    return a.join(b, ["r", "c"]).groupBy(a_id, b_id).agg(F.count(F.lit(1)).alias("n"))
