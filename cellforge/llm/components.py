"""Connected components by alternating stars, with joins and sums alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _minima(e: DataFrame) -> DataFrame:
    # Kept before it is joined back: a join that also ends a sum could not be split where a node is a hub.
    return stored(e.groupBy("u").agg(F.min("v").alias("m")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for the ends of ``edges`` (u, v), label being the smallest node that links reach.

    Each round hangs a node's larger neighbours, then its smaller ones, on its smallest neighbour; the
    rounds end when the edges no longer change. A hub's neighbours are never gathered: its minimum is
    a partial sum, and the join back is one that Spark splits. Nulls, loops and repeated edges are dropped.
    """
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _minima(both).withColumn("m", F.least("u", "m"))
        large = stored(both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        m = _minima(large)
        hung = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(hung.unionByName(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
