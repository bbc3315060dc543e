"""Scalar functions: sigmoid curves, kernels' weights and normalisation, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x: Column, left: float = 1.0, inflection: float = 5.0, steepness: float = 1.0, magnitude: float = 1.0) -> Column:
    """left / (1 / magnitude + exp(steepness * (x - inflection)))"""
    d = lambda v: F.lit(float(v))
    return d(left) / (d(1 / magnitude) + F.exp(d(steepness) * (x - d(inflection))))


def first_order(x: Column, left=1.0, inflection=5.0, steepness=1.0, magnitude=1.0, scalar=1.0) -> Column:
    return F.lit(float(scalar)) * sigmoid(x, left, inflection, steepness, magnitude)


def summed(x: Column, lefts: tuple[float, ...], inflections: tuple[float, ...], steepness: float = 1.0, magnitude: float = 1.0, scalar: float = 1.0) -> Column:
    """Sum of curves that differ in their left values and inflections."""
    total = F.lit(0.0)
    for left, at in zip(lefts, inflections, strict=True):
        total = total + sigmoid(x, left, at, steepness, magnitude)
    return F.lit(float(scalar)) * total


def second_order(x: Column, **more) -> Column:
    return summed(x, (-1.0, 1.0), (5.0, 15.0), **more)


def third_order(x: Column, **more) -> Column:
    return summed(x, (1.0, -1.0, 1.0), (5.0, 15.0, 25.0), **more)


def kernel_weight(distance: Column, half_life: float, start: float = 1.0) -> Column:
    """Weight at a distance: a curve that has lost half of its start at ``half_life``."""
    return first_order(distance, left=start, inflection=half_life, steepness=4.0 / half_life)


def at_distance(x: Column, y: Column, function: Callable[[Column], Column]) -> Column:
    """A function of the Euclidean distance."""
    return function(F.sqrt(x * x + y * y))


def normalise(df: DataFrame, value: str, low: float = 0.0, high: float = 1.0, log: bool = False, out: str = "normal") -> DataFrame:
    """(x - min) * (high - low) / (max - min), of log(x - min + 1) if ``log``; two scalars are joined back, no window over all rows. A constant layer gives NULL."""
    least = df.agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    span = (F.log(F.col("__b") - F.col("__a") + 1) if log else F.col("__b") - F.col("__a")).alias("s")
    x = F.log(F.col(value) - F.col("__a") + 1) if log else F.col(value) - F.col("__a")
    return df.crossJoin(least).withColumn(out, F.try_divide(x * F.lit(float(high - low)), span)).drop("__a", "__b")


def symmetric_range(df: DataFrame, value: str, nodata: float = -9999.0, stretch: float = 1.5) -> DataFrame:
    """(low, high), symmetric about 0, of what is not no data."""
    most = F.max(F.abs(F.col(value))) * F.lit(float(stretch))
    return df.where(F.col(value) != nodata).agg((-most).alias("low"), most.alias("high"))
