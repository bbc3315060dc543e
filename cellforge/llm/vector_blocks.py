"""Blocks of vectors of a bounded size, and what searches over pairs of blocks share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

QUERY_BLOCK = 8192


def numbered(vectors: DataFrame, *more: Column | str) -> DataFrame:
    """``vectors`` (vec_id, v) with a number for each row, ``row``, its length, ``norm``, and ``more``; stored, so that rows keep their numbers."""
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return stored(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.least(F.sqrt(square), F.lit(1.7e308)).alias("norm"), *more))


def dealt(x: DataFrame, rows: int, size: int, *order: Column | str) -> DataFrame:
    """``x`` of ``rows`` rows with ``block``: from 0, of about ``size`` rows each, rising in ``order``; stored."""
    n = max(1, -(-rows // size))
    y = stored(x.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    parts = (y.agg(F.max("part").alias("p")).first()["p"] or 0) + 1  # Spark may have taken more than asked for
    return y.withColumn("block", F.floor(F.col("part") * n / parts).cast("int")).drop("part")


def query_block(row: str, n: int) -> Column:
    """Which of ``n`` blocks of queries a row belongs to."""
    return F.pmod(F.xxhash64(row), F.lit(max(1, n))).cast("int")


def prefix(tops: Column, reaches) -> Column:
    """How many of ``tops``, which fall, reach what is asked of them: a binary search, so a row looks at few of them."""
    first = F.struct(F.lit(0).alias("low"), F.size(tops).alias("high"))

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        hit = reaches(F.get(tops, middle))
        return F.when(s["low"] >= s["high"], s).when(hit, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), first, step, lambda s: s["low"])


def matrix(values: pd.Series, dims: int, kind: type = np.int64) -> np.ndarray:
    """Vectors side by side, a row for each dimension; shorter ones end in zeros."""
    lengths = values.map(len)
    if len(values) and (lengths == dims).all():
        return np.ascontiguousarray(np.stack(values.to_numpy()).astype(kind, copy=False).T)
    out = np.zeros((dims, len(values)), kind)
    for k, v in enumerate(values):
        out[: len(v), k] = v
    return out


def widest(*columns: pd.Series) -> int:
    return max((int(c.map(len).max()) for c in columns if len(c)), default=0)
