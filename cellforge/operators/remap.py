"""Per-cell operators on categorical and continuous layers. Maps are long tables keyed by (r, c); NULL is no data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["r", "c"]


def lookup(value: Column, table: Mapping[int, int]) -> Column:
    """``table[value]`` without a join, for small fixed tables; unmapped values are NULL."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), value.cast("int"))


def reclassify(cells: DataFrame, table: Mapping[int, int], value: str = "lulc", out: str = "class_id") -> DataFrame:
    return cells.withColumn(out, lookup(F.col(value), table))


def reclassify_by(cells: DataFrame, table: DataFrame, value: str, code: str, out: str) -> DataFrame:
    """As ``reclassify`` by a table (code, out); Spark broadcasts it while its size allows."""
    return cells.join(table.select(F.col(code).alias(value), out), value, "left")


def class_binaries(cells: DataFrame, classes: Sequence[int], value: str = "class_id") -> DataFrame:
    """One 0/1 column for each class; NULL counts as absent."""
    return cells.select(*CELL, *(F.coalesce((F.col(value) == k).cast("int"), F.lit(0)).alias(f"is_{k}") for k in classes))


def class_binaries_long(cells: DataFrame, classes: Sequence[int], value: str = "class_id") -> DataFrame:
    """(r, c, class_id, present) for every cell and class."""
    x = cells.withColumn("__k", F.explode(F.array(*(F.lit(k) for k in classes))))
    return x.select(*CELL, F.col("__k").alias("class_id"), F.coalesce((F.col(value) == F.col("__k")).cast("int"), F.lit(0)).alias("present"))


def valid_mask(value: Column) -> Column:
    return value.isNotNull().cast("int")


def change_present(value: Column, nodata: float = -9999.0) -> Column:
    """Whether a change is known and not 0."""
    return F.coalesce((value != 0) & (value != nodata) & ~F.isnan(value.cast("double")), F.lit(False))


def fill_where_not_changed(changed: Column, baseline: Column, detailed: Column) -> Column:
    """The detailed code where the simple class did not change, else the new class."""
    return F.when(changed == baseline, detailed).otherwise(changed)


def restore_detailed(value: Column, table: Mapping[int, int]) -> Column:
    """Simple classes as detailed codes; detailed codes and no data stay."""
    return F.coalesce(lookup(value, table), value)


def null_safe_difference(base: Column, future: Column) -> Column:
    return F.when(base.isNotNull(), future - base)


def share_to_hectares(first: Column, total: Column, hectares: Column) -> Column:
    """Total shares as hectares where the first state is known."""
    return F.when(first.isNotNull(), total * hectares)


def transition_category(baseline: Column, observed: Column, projected: Column, k: Column) -> Column:
    """1 the class was there; 2 only observed, 3 only projected, 4 both as new; else 0."""
    o, p = observed == k, projected == k
    return F.when(baseline == k, 1).when(o & p, 4).when(p, 3).when(o, 2).otherwise(0)


def expansion_contraction(baseline: Column, projected: Column, k: Column) -> Column:
    """1 expansion, 2 presence, 3 contraction, NULL none."""
    return F.when((projected == k) & (baseline != k), 1).when((projected == k) & (baseline == k), 2).when((projected != k) & (baseline == k), 3)


def expansion_or_contraction(baseline: Column, projected: Column, k: Column) -> Column:
    """1 expansion, 2 contraction, NULL none or mere presence."""
    return F.when((projected == k) & (baseline != k), 1).when((projected != k) & (baseline == k), 2)
