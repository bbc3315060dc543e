"""Aggregation of fine cells to coarse ones, and coarse states to classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .remap import null_safe_difference

COARSE = ["cr", "cc"]


def change_matrix(cells: DataFrame, before: str, after: str, classes: Sequence[int], diagonal: bool = True, by: Sequence[str] = COARSE) -> DataFrame:
    """(by..., from_class, to_class, n): fine cells that went from one listed class to another."""
    x = cells.where(F.col(before).isin(*classes) & F.col(after).isin(*classes))
    x = x if diagonal else x.where(F.col(before) != F.col(after))
    return x.groupBy(*by, F.col(before).alias("from_class"), F.col(after).alias("to_class")).agg(F.count(F.lit(1)).alias("n"))


def dense_change_matrix(matrix: DataFrame, classes: Sequence[int], by: Sequence[str] = COARSE) -> DataFrame:
    """All pairs of classes for each coarse cell that occurs, 0 where nothing went."""
    k = F.array(*(F.lit(x) for x in classes))
    frame = matrix.select(*by).distinct().withColumn("from_class", F.explode(k)).withColumn("to_class", F.explode(k))
    return frame.join(matrix, [*by, "from_class", "to_class"], "left").fillna(0, ["n"])


def net_change(matrix: DataFrame, by: Sequence[str] = COARSE) -> DataFrame:
    """(by..., class_id, n): cells gained less cells lost."""
    moved = matrix.where("from_class <> to_class")
    signed = moved.select(*by, F.explode(F.array(F.struct(F.col("to_class").alias("class_id"), F.col("n").alias("d")), F.struct(F.col("from_class").alias("class_id"), (-F.col("n")).alias("d")))).alias("x"))
    return signed.groupBy(*by, "x.class_id").agg(F.sum("x.d").alias("n"))


def net_change_hectares(net: DataFrame, hectares: DataFrame, ratio: int) -> DataFrame:
    """Net cells as hectares: a fine cell has its coarse cell's hectares / ratio squared."""
    return net.join(hectares, COARSE).select(*COARSE, "class_id", (F.col("n") * F.col("ha") / (ratio * ratio)).alias("ha"))


def goals(cells: DataFrame, before: str, after: str, ha: str, classes: Sequence[int]) -> DataFrame:
    """(cr, cc, class_id, goal): hectares gained less hectares lost, from two maps."""
    moved = cells.where(F.col(before) != F.col(after))
    signed = moved.select(*COARSE, F.explode(F.array(F.struct(F.col(after).alias("class_id"), F.col(ha).alias("d")), F.struct(F.col(before).alias("class_id"), (-F.col(ha)).alias("d")))).alias("x"))
    return signed.where(F.col("x.class_id").isin(*classes)).groupBy(*COARSE, "x.class_id").agg(F.sum("x.d").alias("goal"))


def state_stack(cells: DataFrame, value: str, ratio: int) -> DataFrame:
    """(cr, cc, class_id, share): each class's part of the coarse cell."""
    return cells.groupBy(*COARSE, F.col(value).alias("class_id")).agg((F.count(F.lit(1)) / F.lit(float(ratio * ratio))).alias("share"))


def valid_share(cells: DataFrame, value: str) -> DataFrame:
    return cells.groupBy(*COARSE).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("valid"))


def scaled_change(goal: DataFrame, share: DataFrame) -> DataFrame:
    return goal.join(share, COARSE).withColumn("goal", F.col("goal") * F.col("valid"))


def states_to_classes(states: DataFrame, table: Mapping[str, str], hectares: DataFrame | None = None, by: Sequence[str] = COARSE) -> DataFrame:
    """(by..., class, value): member states' shares summed, as hectares if an area table is given.

    As in the model, the first member state in order of name decides whether a cell has data.
    """
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    x = states.withColumn("class", F.try_element_at(F.create_map(*pairs), F.col("state"))).where(F.col("class").isNotNull())
    x = x.groupBy(*by, "class").agg(F.min_by("share", "state").alias("first"), F.sum("share").alias("total"))
    if hectares is None:
        return x.select(*by, "class", F.when(F.col("first").isNotNull(), F.col("total")).alias("value"))
    return x.join(hectares, COARSE).select(*by, "class", F.when(F.col("first").isNotNull(), F.col("total") * F.col("ha")).alias("value"))


def difference(base: DataFrame, future: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """``future`` less ``base`` by key, NULL where the base is."""
    f = future.select(*key, F.col(value).alias("__f"))
    return base.join(f, list(key)).select(*key, null_safe_difference(F.col(value), F.col("__f")).alias("change"))


def row_area_difference(base: DataFrame, scenario: DataFrame, area: DataFrame, key: Sequence[str], value: str = "share") -> DataFrame:
    """(scenario - base) times an area that depends on the coarse row alone."""
    s = scenario.select(*key, F.col(value).alias("__s"))
    return base.join(s, list(key)).join(area, "cr").select(*key, ((F.col("__s") - F.col(value)) * F.col("ha")).alias("change"))


def difference_from_observed(observed: DataFrame, scenario: DataFrame, area: DataFrame, key: Sequence[str], value: str = "share") -> DataFrame:
    """As ``row_area_difference``, from what the observed map implies: where it lacks a class of ``scenario``, from 0."""
    o = observed.select(*key, F.col(value).alias("__o"))
    return scenario.join(o, list(key), "left").join(area, "cr").select(*key, ((F.col(value) - F.coalesce("__o", F.lit(0.0))) * F.col("ha")).alias("change"))


def value_counts(cells: DataFrame, value: str) -> DataFrame:
    return cells.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def layer_statistics(cells: DataFrame, value: str) -> DataFrame:
    x = F.col(value)
    return cells.agg(F.min(x).alias("least"), F.max(x).alias("most"), F.sum(x).alias("total"), F.count_if(x != 0).alias("nonzero"), F.count_distinct(x).alias("n_distinct"), F.max(F.abs(x)).alias("symmetric"))


def changed_cells(cells: DataFrame, before: str, after: str) -> DataFrame:
    return cells.agg(F.count_if(F.col(before) != F.col(after)).alias("n"))


def class_rates(cells: DataFrame, before: str, after: str) -> DataFrame:
    """(class_id, rate): a class's growth weighted by its part of the first map's cells that are not 0."""
    a = cells.where(F.col(before) != 0).groupBy(F.col(before).alias("class_id")).agg(F.count(F.lit(1)).alias("n1"))
    b = cells.where(F.col(after) != 0).groupBy(F.col(after).alias("class_id")).agg(F.count(F.lit(1)).alias("n2"))
    total = a.agg(F.sum("n1").alias("total"))
    x = a.join(b, "class_id", "left").crossJoin(total)  # one row
    return x.select("class_id", ((F.col("n1") / F.col("total")) * ((F.coalesce("n2", F.lit(0)) - F.col("n1")) / F.col("n1"))).alias("rate"))


def mosaic(matrix: DataFrame, n_classes: int) -> DataFrame:
    """The change matrices as one picture: each coarse cell is a block of n_classes by n_classes."""
    at = lambda coarse, k: (F.col(coarse) * n_classes + F.col(k) - 1).cast("int")
    return matrix.select(at("cr", "from_class").alias("r"), at("cc", "to_class").alias("c"), "n")


def from_mosaic(picture: DataFrame, n_classes: int) -> DataFrame:
    """Change matrices out of ``mosaic``."""
    coarse = lambda x: F.floor(F.col(x) / n_classes).cast("int")
    return picture.select(coarse("r").alias("cr"), coarse("c").alias("cc"), (F.col("r") % n_classes + 1).cast("int").alias("from_class"), (F.col("c") % n_classes + 1).cast("int").alias("to_class"), "n")
