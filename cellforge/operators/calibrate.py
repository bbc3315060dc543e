"""Coefficient tables and the tries of a calibration; the search over them is in ``search``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .allocate import ADDITIVE, COARSE, MULTIPLICATIVE, allocatable, claims, winners
from .fit import fit_loss, weighted_score
from .remap import CELL

# Steps by which a coefficient that helped is tried further, down and up.
SCALES = (0.00001, 0.0001, 0.001, 0.01, 0.1, 0.5, 0.75, 1.5, 2.0, 10.0, 100.0, 1000.0, 10000.0, 100000.0)

#: Fixed value: what one class's presence nearby adds for another, where it is neither 1 nor, for the class itself, 10.
ADJACENCY = {(1, 2): 5.0}


def starting_coefficients(spark: SparkSession, classes: Mapping[int, str], changeable: Sequence[int], sigmas: Sequence[float], static: Sequence[str], frozen: Sequence[int] = (1, 6, 7), adjacency: Mapping[tuple[int, int], float] | None = None) -> DataFrame:
    """(layer, kind, class_id, beta): presence constraints, presence, convolutions of each class and static layers.

    A constraint is 0 for the class itself and for classes that may not be taken, else 1; presence
    starts at 0, a convolution at the classes' adjacency over its width, a static layer at 1.
    """
    k = spark.createDataFrame([(i, n) for i, n in classes.items()], "source int, name string")
    target = k.withColumn("class_id", F.explode(F.array(*(F.lit(c) for c in changeable))))
    constraint = target.select(F.concat("name", F.lit("_constraint")).alias("layer"), F.lit(MULTIPLICATIVE).alias("kind"), "class_id", F.when((F.col("source") == F.col("class_id")) | F.col("source").isin(*frozen), 0.0).otherwise(1.0).alias("beta"))
    presence = target.select(F.concat("name", F.lit("_presence")).alias("layer"), F.lit(ADDITIVE).alias("kind"), "class_id", F.lit(0.0).alias("beta"))
    near = adjacency or {(a, b): 10.0 if a == b else ADJACENCY.get((a, b), 1.0) for a in classes for b in changeable}
    table = spark.createDataFrame([(a, b, float(v)) for (a, b), v in near.items()], "source int, class_id int, near double")
    wide = target.join(table, ["source", "class_id"], "left").withColumn("sigma", F.explode(F.array(*(F.lit(float(s)) for s in sigmas))))
    convolved = wide.select(F.concat_ws("_", "name", F.lit("gaussian"), F.col("sigma").cast("int")).alias("layer"), F.concat(F.lit("gaussian_"), F.col("sigma").cast("int")).alias("kind"), "class_id", (F.coalesce("near", F.lit(0.0)) / F.col("sigma")).alias("beta"))
    s = spark.createDataFrame([(n,) for n in static], "layer string").withColumn("class_id", F.explode(F.array(*(F.lit(c) for c in changeable))))
    rest = s.select("layer", F.lit(ADDITIVE).alias("kind"), "class_id", F.lit(1.0).alias("beta"))
    return constraint.unionByName(presence).unionByName(convolved).unionByName(rest)


def sparse_starting_coefficients(spark: SparkSession, classes: Mapping[int, str], changeable: Sequence[int], static: Sequence[str], given: Sequence[str], frozen: Sequence[int] = (6, 7)) -> DataFrame:
    """The older start, of the same columns: all 0, but for 1 at a class's own wide convolution (5) and at the static layers ``given``; each layer that is not a constraint is additive."""
    x = starting_coefficients(spark, classes, changeable, (1, 5), static, frozen, {(a, b): 5.0 if a == b else 0.0 for a in classes for b in changeable})
    none = (F.col("kind") == "gaussian_1") | F.col("layer").isin(*(set(static) - set(given)))
    kind = F.when(F.col("kind").startswith("gaussian_"), ADDITIVE).otherwise(F.col("kind"))
    return x.select(F.regexp_replace("layer", "_constraint$", "_presence_constraint").alias("layer"), kind.alias("kind"), "class_id", F.when(none, 0.0).otherwise(F.col("beta")).alias("beta"))


def candidate_tries(coefficients: DataFrame, step: float = 1.0) -> DataFrame:
    """(try_id, layer, class_id, delta): 0 the start, then one step down and one up for each coefficient that is not multiplicative.

    Numbered by layer, class and sign; the numbering sorts the coefficient table, which is small.
    """
    from pyspark.sql import Window as W

    x = coefficients.where(F.col("kind") != MULTIPLICATIVE).withColumn("delta", F.explode(F.array(F.lit(-step), F.lit(step))))
    x = x.withColumn("try_id", F.row_number().over(W.orderBy("layer", "class_id", "delta")).cast("long")).select("try_id", "layer", "class_id", "delta")
    start = coefficients.sparkSession.createDataFrame([(0, None, None, 0.0)], "try_id long, layer string, class_id int, delta double")
    return start.unionByName(x)


Coefficients = dict[int, list[tuple[str, str, float]]]
Move = tuple[str, int, float]  # layer, class, what is added to its coefficient


def scored_tries(cells: DataFrame, start: Coefficients, moves: Sequence[Move | None], lulc: str = "lulc") -> DataFrame:
    """(try_id, r, c, cr, cc, lulc, ha, class_id, s): suitability under ``start`` with each of ``moves`` (None: none) on its own, from one scan.

    A cell carries its layers as arrays; tries and classes are exploded, and coefficients of 0 (additive) or 1 (multiplicative) take no part.
    """
    adds = sorted({n for rows in start.values() for n, kind, _ in rows if kind != MULTIPLICATIVE})
    times = sorted({n for rows in start.values() for n, kind, _ in rows if kind == MULTIPLICATIVE})
    listed = lambda names: F.array(*(F.col(n).cast("double") for n in names)) if names else F.array().cast("array<double>")
    numbers = lambda values: F.array(*(F.lit(float(v)) for v in values)) if values else F.array().cast("array<double>")
    tries = F.array(*(F.struct(F.lit(t).alias("try_id"), F.lit(adds.index(m[0]) if m else -1).alias("layer"), F.lit(m[1] if m else -1).alias("class_id"), F.lit(float(m[2]) if m else 0.0).alias("delta")) for t, m in enumerate(moves)))
    own = {k: {n: b for n, _, b in rows} for k, rows in start.items()}
    classes = F.array(*(F.struct(F.lit(k).alias("class_id"), numbers([own[k].get(n, 0.0) for n in adds]).alias("b"), numbers([own[k].get(n, 1.0) for n in times]).alias("m")) for k in start))
    x = cells.select(*CELL, *COARSE, lulc, "ha", listed(adds).alias("xa"), listed(times).alias("xm"), F.explode(tries).alias("t"))
    x = x.withColumn("k", F.explode(classes)).where(F.col(lulc) != F.col("k.class_id"))
    beta = F.transform("k.b", lambda b, i: F.when((F.col("t.class_id") == F.col("k.class_id")) & (F.col("t.layer") == i), b + F.col("t.delta")).otherwise(b))
    total = F.aggregate(F.zip_with(beta, "xa", lambda b, v: F.when(b == 0, 0.0).otherwise(b * v)), F.lit(0.0), lambda s, v: s + v)
    factor = F.aggregate(F.zip_with("k.m", "xm", lambda b, v: F.when(b == 1, 1.0).otherwise(1 - (1 - b) * v)), F.lit(1.0), lambda s, v: s * v)
    x = x.select(F.col("t.try_id").alias("try_id"), *CELL, *COARSE, lulc, "ha", F.col("k.class_id").alias("class_id"), (total * factor).alias("s"))
    return x.where(allocatable(F.col("s")))


def evaluate(cells: DataFrame, start: Coefficients, moves: Sequence[Move | None], goals: DataFrame, observed: str, sigma: float, n_rows: int, n_cols: int, lulc: str = "lulc") -> DataFrame:
    """(try_id, changed, loss, score) of all ``moves``, numbered from 0, in one job: ranks, goals and losses are kept apart by try_id."""
    ids = F.array(*(F.lit(t) for t in range(len(moves))))
    g = goals.withColumn("try_id", F.explode(ids))
    won = winners(claims(scored_tries(cells, start, moves, lulc), g, by=["try_id", *COARSE]), keep=["try_id"])
    grid = cells.select(*CELL, lulc, F.col(observed).alias("observed")).withColumn("try_id", F.explode(ids))
    maps = grid.join(won, ["try_id", *CELL], "left").select("try_id", *CELL, F.col(lulc).alias("baseline"), F.coalesce("new", lulc).alias("projected"), "observed")
    loss = fit_loss(maps, list(start), sigma, n_rows, n_cols, by=["try_id"])
    return weighted_score(maps, loss, by=["try_id"])
