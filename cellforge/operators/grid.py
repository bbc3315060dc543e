"""Operators on the geometry of grids: windows, levels, overlays and extents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .remap import CELL


def window(cells: DataFrame, r0: int, c0: int, n_rows: int, n_cols: int) -> DataFrame:
    """The cells of a block; the bounds reach the scan."""
    return cells.where(F.col("r").between(r0, r0 + n_rows - 1) & F.col("c").between(c0, c0 + n_cols - 1))


def bbox_window(cells: DataFrame, bbox: tuple[float, float, float, float], resolution: float, top: float = 90.0, left: float = -180.0) -> DataFrame:
    """The cells whose centres lie in (min x, min y, max x, max y), by index and not by distance."""
    import math

    x0, y0, x1, y1 = bbox
    c0, c1 = math.floor((x0 - left) / resolution + 0.5), math.ceil((x1 - left) / resolution - 0.5)
    r0, r1 = math.floor((top - y1) / resolution + 0.5), math.ceil((top - y0) / resolution - 0.5)
    return window(cells, r0, c0, r1 - r0, c1 - c0)


def aoi(features: DataFrame, name: str, iso: str = "iso3") -> DataFrame:
    """All features for 'global', else those with that ISO3 code."""
    return features if name == "global" else features.where(F.upper(F.col(iso)) == name.upper())


def extent(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("r").alias("r0"), F.min("c").alias("c0"), F.max("r").alias("r1"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("n"))


def flip_vertical(cells: DataFrame, n_rows: int) -> DataFrame:
    return cells.withColumn("r", F.lit(n_rows - 1) - F.col("r"))


def coarse_of(index: Column, ratio: int) -> Column:
    return F.floor(index / ratio).cast("int")


def with_coarse(cells: DataFrame, ratio: int) -> DataFrame:
    return cells.withColumns({"cr": coarse_of(F.col("r"), ratio), "cc": coarse_of(F.col("c"), ratio)})


def join_coarse(fine: DataFrame, coarse: DataFrame, ratio: int | None = None, how: str = "inner") -> DataFrame:
    """Coarse values at each fine cell."""
    return (with_coarse(fine, ratio) if ratio else fine).join(coarse, ["cr", "cc"], how)


def upsample(coarse: DataFrame, ratio: int) -> DataFrame:
    """Each coarse row once for every fine cell below it, without a join."""
    steps = F.sequence(F.lit(0), F.lit(ratio - 1))
    x = coarse.withColumn("__i", F.explode(steps)).withColumn("__j", F.explode(steps))
    return x.withColumns({"r": (F.col("cr") * ratio + F.col("__i")).cast("int"), "c": (F.col("cc") * ratio + F.col("__j")).cast("int")}).drop("__i", "__j")


def align(*grids: DataFrame, how: str = "inner", key: list[str] | None = None) -> DataFrame:
    """Co-registered grids side by side, by cell."""
    return reduce(lambda a, b: a.join(b, key or CELL, how), grids)


def overview(cells: DataFrame, factor: int, value: str) -> DataFrame:
    """The most frequent value of each block of ``factor`` by ``factor`` cells, the smallest if equal."""
    x = cells.groupBy((F.floor(F.col("r") / factor)).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c"), value).agg(F.count(F.lit(1)).alias("n"))
    return x.groupBy(*CELL).agg(F.max_by(value, F.struct("n", -F.col(value))).alias(value))


def subset_by_position(blocks: DataFrame, order: list[str], positions: list[int]) -> DataFrame:
    """The blocks at the given places (from 0) of an order; one window over block rows, which are few."""
    at = F.row_number().over(W.orderBy(*order)) - 1
    return blocks.withColumn("position", at).where(F.col("position").isin(positions))


def stitch(tiles: list[DataFrame]) -> DataFrame:
    """Disjoint tiles as one map."""
    return reduce(DataFrame.unionByName, tiles)


def overlay(base: DataFrame, top: DataFrame, value: str) -> DataFrame:
    """``top`` where it has a value, else ``base``."""
    t = top.select(*CELL, F.col(value).alias("__top"))
    return base.join(t, CELL, "left").withColumn(value, F.coalesce("__top", value)).drop("__top")


def overlay_ordered(tiles: DataFrame, value: str, rank: str) -> DataFrame:
    """One value for each cell of overlapping tiles, that of the highest rank."""
    return tiles.where(F.col(value).isNotNull()).groupBy(*CELL).agg(F.max_by(value, rank).alias(value))
