"""Scores of a projected map against an observed one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellforge.storage import stored

from .kernels import gaussian_blur, nearest_sq
from .remap import CELL


def fit_loss(maps: DataFrame, classes: Sequence[int], sigma: float, n_rows: int, n_cols: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., class_id, loss): blurred differences of expansions plus those of contractions, from (r, c, baseline, projected, observed).

    Differences are taken before the blur, which is linear, so one column stands for two; only cells that
    differ are scattered.
    """
    b, p, o = F.col("baseline"), F.col("projected"), F.col("observed")
    is_ = lambda x, k: F.coalesce((x == k).cast("int"), F.lit(0))
    rows = []
    for k in classes:
        more = is_(p, k) * (1 - is_(b, k)) - is_(o, k) * (1 - is_(b, k))
        less = is_(b, k) * (1 - is_(p, k)) - is_(b, k) * (1 - is_(o, k))
        rows.append(F.struct(F.lit(k).alias("class_id"), more.alias("more"), less.alias("less")))
    x = maps.select(*by, *CELL, F.explode(F.array(*rows)).alias("x")).select(*by, *CELL, "x.*").where("more <> 0 OR less <> 0")
    blurred = gaussian_blur(x, ["more", "less"], sigma, n_rows, n_cols, by=[*by, "class_id"])
    return blurred.groupBy(*by, "class_id").agg(F.sum(F.abs("more") + F.abs("less")).alias("loss"))


def overall_loss(loss: DataFrame) -> DataFrame:
    """Each class's loss and, with a NULL class, their sum."""
    return loss.rollup("class_id").agg(F.sum("loss").alias("loss"))


def weighted_score(maps: DataFrame, loss: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., changed, loss, score): changed cells / (loss + 1); more is better. No loss row means 0."""
    changed = maps.groupBy(*by).agg(F.count_if(F.col("baseline") != F.col("projected")).alias("changed"))
    total = loss.groupBy(*by).agg(F.sum("loss").alias("loss"))
    x = changed.join(total, list(by), "left") if by else changed.crossJoin(total)  # one row each
    return x.select(*by, "changed", F.coalesce("loss", F.lit(0.0)).alias("loss"), (F.col("changed") / (F.coalesce("loss", F.lit(0.0)) + 1)).alias("score"))


def distance_similarity(cells: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., metric, predicted): squared distances of the second set's cells to the nearest cell of the first alone, and of the first's to the second alone; and how many of them are not 0.

    Where no cell is in one set alone, that part is 0.
    """
    x = cells.select(*by, *CELL, F.coalesce(F.col(a).cast("boolean"), F.lit(False)).alias("__a"), F.coalesce(F.col(b).cast("boolean"), F.lit(False)).alias("__b"))
    x = stored(x.where("__a OR __b"))  # few cells change
    both = lambda to_a, to_b: x.where(to_a).select(*by, *CELL, F.lit(0).alias("__to")).unionByName(x.where(to_b).select(*by, *CELL, F.lit(1).alias("__to")))
    d = nearest_sq(both("__a AND NOT __b", "__b AND NOT __a"), both("__b", "__a"), [*by, "__to"])
    return d.groupBy(*by).agg(F.coalesce(F.sum("d2"), F.lit(0.0)).alias("metric"), F.count_if(F.col("d2") != 0).alias("predicted"))


def fit_distance(maps: DataFrame, classes: Sequence[int] | None = None) -> DataFrame:
    """(class_id, side, metric, predicted): ``distance_similarity`` of observed and projected changes to and from each class, in one pass.

    ``classes`` is by default every class of the three maps. A class and side without any change has no row. See ``overall_distance`` for the quotient.
    """
    if classes is None:
        ids = maps.select(F.explode(F.array("baseline", "projected", "observed")).alias("k")).where("k IS NOT NULL").distinct()
        classes = sorted(r["k"] for r in ids.collect())  # a row for each class of the maps
    each = maps.withColumn("class_id", F.explode(F.array(*(F.lit(k) for k in classes)))).withColumn("side", F.explode(F.array(F.lit("to"), F.lit("from"))))
    was, k = F.col("baseline") == F.col("class_id"), F.col("class_id")
    changed = lambda x: F.when(F.col("side") == "to", ~was & (F.col(x) == k)).otherwise(was & (F.col(x) != k))
    return distance_similarity(each.select("class_id", "side", *CELL, changed("observed").alias("o"), changed("projected").alias("p")), "o", "p", ["class_id", "side"])


def overall_distance(fits: DataFrame) -> DataFrame:
    """(distance): the sum of ``fit_distance``'s metrics over that of its counts; NULL without any."""
    return fits.agg(F.try_divide(F.sum("metric"), F.sum("predicted")).alias("distance"))


def class_similarity(differences: DataFrame, maps: DataFrame, k: int) -> DataFrame:
    """Sum of differences over the number of expansions of a class."""
    n = maps.agg(F.count_if((F.col("projected") == k) & (F.col("baseline") != k)).alias("n"))
    return differences.agg(F.sum("d").alias("d")).crossJoin(n).select(F.try_divide("d", "n").alias("similarity"))
